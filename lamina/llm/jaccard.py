"""N-gram Jaccard join by MinHash banding.

Texts with the same set of n-grams are one node; each node has a signature of bands * rows minimum
hashes, with the number of bands chosen for the target recall. Nodes that share a band's hash are
candidates, and pairs are verified on their full n-gram sets.

Buckets of at most ``SMALL`` nodes give candidate pairs, once for each distinct set of members. Larger
buckets are joined to families (connected components), whose members are dealt to classes by the size of their
sets, and within a class to blocks of about ``BLOCK`` nodes and ``GRAMS`` n-grams. Only blocks of the same or neighbouring classes can
hold similar sets; they are compared all against all. A pair of blocks gives each node's number of links and a spanning forest,
so no pairs are emitted and no link is lost, however large the group. The counts of links make that work grow with the
square of a family of unlike texts; copies of one text are one node.

Classes are the connected components of the links; class_id is the smallest doc_id. n_links counts
the other documents that a document's set is similar to, copies included.

Nulls: a text that is null or without words is linked to none. Texts of one to four words have one
n-gram of all their words. A null doc_id gets class null and 0 links. Repeated rows are copies of each
other. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import Scratch, WordHashes, mixed, own_columns, shingles, texts_of, word_hashes, words_of
from lamina.llm.components import components

NGRAM, THRESHOLD, ROWS, RECALL = 5, Fraction(4, 5), 10, 0.999
SMALL, BLOCK = 32, 1024
#: N-grams of a block at most, but for a single set.
GRAMS = 1 << 20


def bands_for(threshold: float = float(THRESHOLD), rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands so that a pair just at the threshold shares one with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def gram_set(text: str, hashes: WordHashes, n: int = NGRAM) -> np.ndarray:
    return np.unique(shingles(hashes(words_of(text)), n))


def node_of(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).astype(np.int64))


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 32, bands * rows, np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, np.uint32)
        self.shape, self.odd = (bands, rows), rng.integers(0, 1 << 63, rows, np.uint64) | np.uint64(1)
        self.number = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        x = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for k in range(0, len(x), 512):
            h = self.a[:, None] * x[None, k : k + 512]
            h += self.b[:, None]
            np.minimum(least, h.min(axis=1), out=least)
        return mixed((mixed(least.astype(np.uint64).reshape(self.shape)) * self.odd).sum(axis=1, dtype=np.uint64) ^ self.number).view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int = ROWS) -> DataFrame:
    """doc_id, node (null: no words), n (n-grams), bands."""

    def run(batches):
        hashes, sign = word_hashes(), Signer(bands, rows)
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                sets = [gram_set(t, hashes) for t in texts_of(batch)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([sign(s) if len(s) else None for s in sets], pa.list_(pa.int64()))], ["doc_id", "node", "n", "bands"])

    return own_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, node long, n int, bands array<long>")


def similar(a: np.ndarray, b: np.ndarray, threshold: Fraction = THRESHOLD) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * threshold.denominator >= threshold.numerator * (len(a) + len(b) - both)


def link_matrix(sets: list[np.ndarray], threshold: Fraction = THRESHOLD) -> np.ndarray:
    """Which pairs are similar, by exact intersection counts: frequent n-grams by a matrix product, rare ones pair by pair."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, gram, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = np.zeros((n, n), np.float32)
    rare = (held[gram] > 1) & (held[gram] <= 8)
    order = np.argsort(gram[rare], kind="stable")
    g, o = gram[rare][order], owner[rare][order]
    for d in range(1, 8):
        same = np.flatnonzero(g[:-d] == g[d:]) if len(g) > d else []
        if not len(same):
            break
        both += np.bincount(o[same] * n + o[same + d], minlength=n * n).reshape(n, n).astype(np.float32)
    both += both.T
    often = np.flatnonzero(held > 8)
    column = np.full(len(held), -1)
    column[often] = np.arange(len(often))
    at = column[gram]
    for k in range(0, len(often), 4096):
        here = (at >= k) & (at < k + 4096)
        m = np.zeros((n, min(4096, len(often) - k)), np.float32)
        m[owner[here], at[here] - k] = 1
        both += m @ m.T
    size = np.array([len(s) for s in sets], np.float64)
    links = np.empty((n, n), bool)
    for k in range(0, n, 256):  # by rows: wide numbers for a few at a time
        some = both[k : k + 256].astype(np.float64)
        links[k : k + 256] = some * threshold.denominator >= threshold.numerator * (size[k : k + 256, None] + size[None, :] - some)
    np.fill_diagonal(links, False)
    return links


def forest(links: np.ndarray) -> np.ndarray:
    """The smallest row number that each row is connected to."""
    n = len(links)
    label = np.arange(n)
    while True:
        least = np.array([min(label[k], label[row].min(initial=n)) for k, row in enumerate(links)], np.int64)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of one document of each node (or more, where doc_ids repeat; readers check the node)."""
    return own_columns(docs, "doc_id", "text").join(nodes.select("node", F.col("least").alias("doc_id")), "doc_id").select("node", "text")


def _pairs(members: DataFrame) -> DataFrame:
    """x, y of each two nodes of a small bucket whose sizes allow the threshold; each distinct bucket once."""
    low = float(THRESHOLD)
    buckets = members.groupBy("band").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("m")).select("m").distinct()
    both = F.expr("explode(flatten(transform(sequence(1, size(m) - 1), i -> transform(slice(m, i + 1, size(m)), y -> struct(m[i - 1] as x, y)))))")
    pair = buckets.filter("size(m) > 1").select(both.alias("p")).select(F.col("p.x.node").alias("x"), F.col("p.y.node").alias("y"), F.col("p.x.n").alias("nx"), F.col("p.y.n").alias("ny"))
    return pair.filter((F.least("nx", "ny") >= low * F.greatest("nx", "ny") - 1e-9) & (F.col("x") != F.col("y"))).select("x", "y").distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    x = texts.select(F.col("node").alias("x"), F.col("text").alias("tx"))
    y = texts.select(F.col("node").alias("y"), F.col("text").alias("ty"))

    def run(batches):
        hashes = word_hashes()
        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "tx", "ty"))):
                sa, sb = gram_set(ta or "", hashes), gram_set(tb or "", hashes)
                keep.append(node_of(sa) == a and node_of(sb) == b and similar(sa, sb))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["x", "y"])

    return pairs.join(x, "x").join(y, "y").select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long").distinct()


def _families(members: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """node, copies, least, n, family, cls (size class), block (its number within the family's class)."""
    family = components(members.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), scratch)
    # sets of n and m n-grams can be similar only if n / m is the threshold or more: if their classes differ by one at most
    cls = F.floor(F.log("n") / math.log(1 / float(THRESHOLD))).cast("int")
    rows = family.join(nodes, "node").select("node", "copies", "least", "n", F.col("component").alias("family"), cls.alias("cls"))
    size = rows.groupBy("family", "cls").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / GRAMS)).cast("int").alias("blocks"))
    return rows.join(size, ["family", "cls"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _sets(families: DataFrame, texts: DataFrame) -> DataFrame:
    """family, cls, block, node, copies, grams (the n-gram set, binary): each text is cut up once, however many blocks it meets."""

    def run(batches):
        hashes = word_hashes()
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                sets = [gram_set(t, hashes) for t in texts_of(batch)]
                fine = pa.array([node_of(s) == node for s, node in zip(sets, batch.column("node").to_pylist())], pa.bool_())
                columns = [batch.column(c) for c in ("family", "cls", "block", "node", "copies")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([s.tobytes() for s in sets], pa.binary())], ["family", "cls", "block", "node", "copies", "grams"]).filter(fine)

    rows = families.join(texts, "node").select("family", "cls", "block", "node", "copies", "text")
    return rows.mapInArrow(run, "family long, cls int, block int, node long, copies long, grams binary")


def _compared(sets: DataFrame, families: DataFrame) -> DataFrame:
    """Blocks of each family, each against those of its own and the next size class: (a, null, links) for each node's links with weight, and (a, b, null) for a spanning forest."""
    blocks = families.groupBy("family", "cls").agg(F.max("blocks").alias("blocks"))
    numbers = blocks.select("family", F.col("cls").alias("other"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("number"))
    near = numbers.withColumn("cls", F.explode(F.array(F.col("other") - 1, F.col("other"), F.col("other") + 1)))
    placed = sets.join(near, ["family", "cls"])
    mine, theirs = F.struct("cls", "block"), F.struct(F.col("other").alias("cls"), F.col("number").alias("block"))
    placed = placed.select("family", "node", "copies", "grams", (mine <= theirs).alias("first"), F.least(mine, theirs).alias("i"), F.greatest(mine, theirs).alias("j"))

    def run(group: pa.Table) -> pa.Table:
        seen, keep = set(), []
        for k, node in enumerate(group.column("node").to_pylist()):
            if node not in seen:
                seen.add(node)
                keep.append(k)
        group = group.take(pa.array(keep))
        links = link_matrix([np.frombuffer(g, np.uint64) for g in group.column("grams").to_pylist()])
        if group.column("i")[0] != group.column("j")[0]:
            side = np.asarray(group.column("first"))
            links &= side[:, None] != side[None, :]
        node, weight = np.asarray(group.column("node")), np.asarray(group.column("copies")).astype(np.float64)
        count, root = links @ weight, forest(links)
        joined = np.flatnonzero(root != np.arange(len(root)))
        counted = np.flatnonzero(count)
        none = lambda n: np.zeros(n, bool)
        b = pa.array(np.concatenate([np.zeros(len(counted), np.int64), node[root[joined]]]), mask=np.r_[~none(len(counted)), none(len(joined))])
        n = pa.array(np.concatenate([count[counted].astype(np.int64), np.zeros(len(joined), np.int64)]), mask=np.r_[none(len(counted)), ~none(len(joined))])
        return pa.table({"a": pa.array(np.concatenate([node[counted], node[joined]])), "b": b, "links": n})

    return placed.groupBy("family", "i", "j").applyInArrow(run, "a long, b long, links long")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links for every document."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.written(signatures(docs, bands_for()))
    all_nodes = scratch.written(rows.filter("node is not null and doc_id is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    nodes = all_nodes.select("node", "copies", "least")
    sized = all_nodes.select("node", "copies", "least", "n")
    exploded = all_nodes.select("node", "n", F.explode("bands").alias("band"))
    buckets = exploded.groupBy("band").agg(F.count("*").alias("m"), F.min("node").alias("hub")).filter("m > 1")
    members = scratch.written(exploded.join(buckets, "band"))
    pairs = scratch.written(_pairs(members.filter(F.col("m") <= SMALL)))
    large = members.filter(F.col("m") > SMALL)
    wanted = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node")))
    if large.isEmpty():
        families = None
    else:
        families = scratch.written(_families(large, sized, scratch))
        of = families.select("node", "family")
        same = pairs.join(of.withColumnsRenamed({"node": "x", "family": "fx"}), "x").join(of.withColumnsRenamed({"node": "y", "family": "fy"}), "y").filter("fx = fy")
        pairs = scratch.written(pairs.join(same.select("x", "y"), ["x", "y"], "left_anti"))
        wanted = wanted.unionByName(families.select("node"))
    texts = scratch.written(_texts(docs, nodes.join(wanted.distinct(), "node", "left_semi")))
    links = scratch.written(_verified(pairs, texts))
    edges = links.select(F.col("x").alias("a"), F.col("y").alias("b"))
    ways = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    counts = ways.join(nodes.select(F.col("node").alias("y"), "copies"), "y").groupBy(F.col("x").alias("node")).agg(F.sum("copies").alias("links"))
    if families is not None:
        blocks = scratch.written(_compared(scratch.written(_sets(families, texts)), families))
        edges = edges.unionByName(blocks.filter("b is not null").select("a", "b"))
        counts = counts.unionByName(blocks.filter("links is not null").select(F.col("a").alias("node"), "links")).groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(edges, scratch)
    least = classes.join(nodes, "node").groupBy("component").agg(F.min("least").alias("class_id"))
    per_node = nodes.join(classes.join(least, "component").select("node", "class_id"), "node", "left").join(counts, "node", "left")
    per_node = per_node.select("node", F.coalesce("class_id", "least").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = rows.select("doc_id", "node").join(per_node, "node", "left")
    return scratch.keep(named.select("doc_id", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).alias("n_links")))


def kept(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns, whatever those are called.

    The classes are those of the texts' n-gram sets, so rows of one doc_id with unlike texts are in different groups, and each group keeps a
    row: of those with the smallest doc_id (null ones last) one with the least hash of its text. Texts without words, null ones too, are alike
    to none; of such rows all stay but repeats of the same doc_id and text.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.written(docs.select(F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row")).select("row", F.xxhash64("row.doc_id", "row.text").alias("mark"), F.monotonically_increasing_id().alias("place")))
    # each row by itself: its place stands for the document
    classes = joined(rows.select(F.col("place").alias("doc_id"), F.col("row.text").alias("text"))).select(F.col("doc_id").alias("place"), "class_id")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("mark"), F.col("place"))
    of = rows.select("place", F.col("row.doc_id").alias("doc_id"), "mark", F.length(F.regexp_replace(F.coalesce("row.text", F.lit("")), "[\\x20\\x09-\\x0D]+", "")).alias("chars")).join(classes, "place")
    group = F.when(F.col("chars") == 0, F.col("mark")).otherwise(F.col("class_id"))
    best = of.groupBy(group.alias("group"), (F.col("chars") == 0).alias("empty")).agg(F.min(rank).alias("best")).select(F.col("best.place").alias("place"))
    return scratch.keep(rows.join(best, "place", "left_semi").select(*(F.col("row").getField(n).alias(n) for n in docs.columns)))
