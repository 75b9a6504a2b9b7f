"""Near-duplicate documents by b-bit MinHash (operator 5).

Every distinct shingle set is signed with 128 minima: 32 bands of 4 minima are
its candidate keys, and the low 4 bits of all minima, packed as bit planes, are
its sketch. Sets that share a key are candidates. A candidate pair is estimated
by counting the sketch bits that differ, corrected for chance agreement, and
links only if its full sets do.

Components do not need every pair of a group. A key's members are first held
against one leader; then only keys whose members are in different components go
on: small ones pair by pair, large ones against another leader and finally member
by member across components, in blocks of bounded size. A true link that shares a key therefore always ends in
one component, while a group of copies costs rows in proportion to its size.
Equal sets are one node throughout.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldbook.llm.common import BROADCAST_ROWS, bounded_broadcast, located, per_text, salted_join, with_leaders
from fieldbook.session import materialize

#: Bands, minima in a band, low bits kept of each minimum.
BANDS, ROWS, BITS = 32, 4, 4
MINIMA = BANDS * ROWS
#: Pairs whose estimate is this many standard deviations below the threshold are not held against each other.
DEVIATIONS = 6.0
#: Keys of at most this many members are compared as pairs of rows; larger ones in blocks.
SMALL = 16
#: Members of a key, and shingles that they have together, compared in one task on either side, about.
BLOCK, BLOCK_SHINGLES = 256, 1_000_000

_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
_TERMS = _RANDOM.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_BAND = _RANDOM.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_BAND_TERMS = _RANDOM.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_PLACE = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int, seed: int = 0) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles of ``size`` words; of fewer words, one for all; none for none."""
    # bytes.lower() changes A-Z only and bytes.split() splits at ASCII white space only.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter((xxhash.xxh3_64_intdigest(x, seed) for x in words), np.uint64, n)
    take = min(n, size)
    total = np.full(n - take + 1, 0 if take == size else take, np.uint64)
    for k in range(take):
        total += w[k : n - take + 1 + k] * _PLACE[k]
    return np.unique(_mix(total))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each permutation over the set."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 4096):
        out = np.minimum(out, (low[start : start + 4096, None] * _FACTORS + _TERMS).min(0))
    return out


def sign(texts: list[str | None], size: int, seed: int = 0) -> list[list]:
    """For each text: set size, node (hash of the set) and its check hash, band keys, sketch planes."""
    counts, nodes, checks, keys, planes = [], [], [], [], []
    for text in texts:
        hashes = shingles(text, size, seed)
        counts.append(len(hashes))
        raw = hashes.tobytes()
        nodes.append(xxhash.xxh3_64_intdigest(raw, seed) - (1 << 63))
        checks.append(xxhash.xxh3_64_intdigest(raw, seed + 1) - (1 << 63))
        low = minima(hashes)
        keys.append(_mix((low.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(1) + _BAND_TERMS).view(np.int64))
        bits = (low[None, :] >> np.arange(BITS, dtype=np.uint32)[:, None]) & np.uint32(1)
        planes.append(np.packbits(bits.astype(bool), axis=1).reshape(-1).view(np.int64))
    return [counts, nodes, checks, keys, planes]


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two sketches: the share of minima whose low bits agree, corrected for agreement by chance."""
    words = MINIMA // 64
    differ = F.lit(0)
    for w in range(words):
        plane = None
        for p in range(BITS):
            x = F.get(a, F.lit(p * words + w)).bitwiseXOR(F.get(b, F.lit(p * words + w)))
            plane = x if plane is None else plane.bitwiseOR(x)
        differ = differ + F.bit_count(plane)
    chance = 1 / (1 << BITS)
    return ((MINIMA - differ) / MINIMA - chance) / (1 - chance)


def _least_estimate(threshold: float) -> float:
    return threshold - DEVIATIONS * float(np.sqrt(threshold * (1 - threshold) / MINIMA)) / (1 - 1 / (1 << BITS))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the graph with edges (a, b), root the least node; nodes without edges are absent.

    Large-star and small-star steps alternate until the edges no longer change,
    a number of rounds that grows with the logarithm of a component's size. Each
    step is an aggregation and a join, so no neighbourhood is held in one task.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "edges-large")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "of")
        small = large.join(least, F.col("a") == F.col("of")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = materialize(small, "edges-small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


class _Graph:
    """Signed documents, the full sets fetched so far, the links found so far."""

    def __init__(self, with_rows: DataFrame, text: str, locator: str, size: int, similarity: tuple[int, int]):
        self.texts = with_rows.select(F.col(locator).alias("locator"), F.col(text).cast("string").alias("text"))
        self.size, self.similarity, self.seed = size, similarity, 0
        self.sets = self.links = None

    def signed(self, ids: DataFrame, id_col: str, locator: str, text: str) -> DataFrame:
        """(doc_id, locator, n, node, check, keys, planes) of every row; again with another seed should two sets share a node."""
        while True:
            rows = ids.select(F.col(id_col).alias("doc_id"), F.col(locator).alias("locator"), F.col(text).cast("string").alias("text"))
            made = StructType.fromDDL("n long, node long, check long, keys array<long>, planes array<long>")
            size, seed = self.size, self.seed
            schema = StructType([*rows.select("doc_id", "locator").schema.fields, *made.fields])
            lists = pa.list_(pa.int64())
            work = per_text(lambda: lambda texts: sign(texts, size, seed), "text", made.names, [pa.int64(), pa.int64(), pa.int64(), lists, lists], ["doc_id", "locator"])
            signed = materialize(rows.mapInArrow(work, schema), "signed")
            self.nodes = materialize(signed.where("n > 0").groupBy("node").agg(F.min(F.struct("locator", "n", "keys", "planes")).alias("one"), F.min("check").alias("c0"), F.max("check").alias("c1")).select("node", "one.*", "c0", "c1"), "nodes")
            if self.nodes.where("c0 <> c1").isEmpty():
                return signed
            self.seed += 2

    def fetch(self, wanted: DataFrame) -> None:
        """Make sure that the full sets of the nodes in ``wanted`` (node) are in ``sets`` (node, n, hashes)."""
        if self.sets is not None:
            wanted = wanted.join(self.sets, "node", "left_anti")
        wanted = materialize(wanted.join(self.nodes.select("node", "locator"), "node"), "wanted")
        n = wanted.limit(BROADCAST_ROWS + 1).count()
        if not n:
            return
        rows = self.texts.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, "locator").select("node", "text")
        size, seed = self.size, self.seed
        work = per_text(lambda: lambda texts: [[shingles(t, size, seed).view(np.int64) for t in texts]], "text", ["hashes"], [pa.list_(pa.int64())], ["node"])
        sets = materialize(rows.mapInArrow(work, "node long, hashes array<long>"), "sets")
        self.sets = sets if self.sets is None else self.sets.unionByName(sets)

    def agree(self, shared: Column, a: Column, b: Column) -> Column:
        """Whether sets of sizes ``a`` and ``b`` that share ``shared`` are similar enough."""
        part, whole = self.similarity
        return shared * whole >= (a + b - shared) * part

    def confirm(self, pairs: DataFrame) -> None:
        """Add the pairs (hub, node) whose sketches and then whose full sets agree to the links.

        A hub may have any number of nodes: what is sent of it goes to each salt
        once, and after the nodes' sets, so that it is never shuffled with them.
        """
        pairs = materialize(pairs, "pairs")
        degree = lambda rows: rows.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
        planes = self.nodes.select("node", "planes", "n")
        near = salted_join(pairs.join(planes.toDF("node", "planes_b", "n_b"), "node"), "hub", "node", planes.toDF("hub", "planes_a", "n_a"), degree(pairs))
        part, whole = self.similarity
        possible = F.least("n_a", "n_b") * whole >= F.greatest("n_a", "n_b") * part
        near = materialize(near.where(possible & (estimate(F.col("planes_a"), F.col("planes_b")) >= _least_estimate(part / whole))).select("hub", "node"), "near-pairs")
        self.fetch(near.select(F.explode(F.array("hub", "node")).alias("node")).distinct())
        if self.sets is None:
            return
        full = salted_join(near.join(self.sets.toDF("node", "set_b"), "node"), "hub", "node", self.sets.toDF("hub", "set_a"), degree(near))
        shared = F.size(F.array_intersect("set_a", "set_b"))
        self.add(full.where(self.agree(shared, F.size("set_a"), F.size("set_b"))).select(F.col("hub").alias("a"), F.col("node").alias("b")))

    def add(self, links: DataFrame) -> None:
        links = materialize(links, "links")
        self.links = links if self.links is None else self.links.unionByName(links)

    def roots(self, members: DataFrame) -> DataFrame:
        """``members`` (key, node, n) with their component, of the keys whose members are in more than one."""
        found = materialize(components(self.links), "roots").withColumnRenamed("node", "of")
        placed = materialize(members.join(found, F.col("node") == F.col("of"), "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")), "members-placed")
        split = materialize(placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("n").alias("n")).where("r0 <> r1").select("key", "n"), "split-keys")
        return salted_join(placed, "key", "node", split.select("key"), split)

    def all_pairs(self, members: DataFrame) -> None:
        """Hold all members of each key, at most ``SMALL``, against those in other components."""
        other = members.select(F.col("key").alias("k"), F.col("node").alias("other"), F.col("root").alias("r"))
        pairs = members.withColumnRenamed("node", "hub").join(other, (F.col("key") == F.col("k")) & (F.col("hub") < F.col("other")) & (F.col("root") != F.col("r")))
        self.confirm(pairs.select("hub", F.col("other").alias("node")).distinct())

    def against_leaders(self, members: DataFrame, turn: int) -> None:
        """Hold each member of a key against the key's leader, unless they are in one component."""
        order = F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("order"), "node", "root")
        led = with_leaders(members.select("key", "node", "root"), "key", "node", order).where("root <> leader.root")
        self.confirm(led.select(F.col("leader.node").alias("hub"), "node").distinct())

    def across(self, members: DataFrame) -> None:
        """Hold the members of each key against those in other components, in blocks.

        Members outside the key's largest component meet all members. First the
        sketches tell which members have a possible partner at all; the full sets
        of those alone are compared.
        """
        planes = self.nodes.select("node", "planes", F.col("n").alias("shingles"))
        rows = materialize(members.drop("n").join(planes, "node"), "across-members")
        parts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("count"), F.sum("shingles").alias("weight"))
        sizes = parts.groupBy("key").agg(F.max(F.struct("count", "weight", F.col("root").alias("main"))).alias("most"), F.sum("count").alias("n"), F.sum("weight").alias("weight"))
        blocks = lambda n, weight: F.ceil(F.greatest(n / BLOCK, weight / BLOCK_SHINGLES))
        sizes = materialize(sizes.select("key", "n", "most.main", blocks(F.col("n") - F.col("most.count"), F.col("weight") - F.col("most.weight")).alias("outer"), blocks(F.col("n"), F.col("weight")).alias("inner")), "across-sizes")
        dealt = lambda some: salted_join(some, "key", "node", sizes.drop("n"), sizes)
        active = materialize(_in_blocks(dealt(rows), self.size, self.similarity, sketches=True), "active").join(rows.select("key", "node", "root"), ["key", "node"])
        self.fetch(active.select("node").distinct())
        if self.sets is None:
            return
        self.add(_in_blocks(dealt(active).join(self.sets, "node"), self.size, self.similarity, sketches=False))


def _in_blocks(rows: DataFrame, size: int, similarity: tuple[int, int], sketches: bool) -> DataFrame:
    """Compare members across components, block by block.

    With sketches: (key, node) of members that have a possible partner. Without:
    links (a, b), enough to join the components that are linked.
    """
    outside = F.col("root") != F.col("main")
    at = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.col(n))
    payload = ["planes", F.col("shingles").alias("n")] if sketches else ["hashes"]
    base = ["key", "node", "root", *payload]
    left = rows.where(outside).select(*base, F.lit(True).alias("left"), at("outer").alias("i"), F.explode(F.sequence(F.lit(0), F.col("inner") - 1)).alias("j"))
    right = rows.select(*base, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("i"), at("inner").alias("j"))
    blocks = left.unionByName(right).groupBy("key", "i", "j")
    part, whole = similarity
    if sketches:
        least = _least_estimate(part / whole)

        def possible(block: pd.DataFrame) -> pd.DataFrame:
            a, b = block[block["left"]], block[~block["left"]]
            if a.empty or b.empty:
                return pd.DataFrame({"key": [], "node": []}).astype("int64")
            pa_, pb = np.stack(a["planes"].to_numpy()), np.stack(b["planes"].to_numpy())
            words = MINIMA // 64
            good = a["root"].to_numpy()[:, None] != b["root"].to_numpy()[None]
            na, nb = a["n"].to_numpy()[:, None], b["n"].to_numpy()[None]
            good &= np.minimum(na, nb) * whole >= np.maximum(na, nb) * part
            differ = np.zeros(good.shape, np.int64)
            for w in range(words):
                plane = np.zeros(good.shape, np.int64)
                for p in range(BITS):
                    plane |= pa_[:, None, p * words + w] ^ pb[None, :, p * words + w]
                differ += np.bitwise_count(plane.view(np.uint64))
            chance = 1 / (1 << BITS)
            good &= ((MINIMA - differ) / MINIMA - chance) / (1 - chance) >= least
            nodes = np.unique(np.concatenate([a["node"].to_numpy()[good.any(1)], b["node"].to_numpy()[good.any(0)]]))
            return pd.DataFrame({"key": np.full(len(nodes), block["key"].iloc[0]), "node": nodes})

        return blocks.applyInPandas(possible, "key long, node long").distinct()

    def linked(block: pd.DataFrame) -> pd.DataFrame:
        a, b = block[block["left"]], block[~block["left"]]
        found: list[tuple[int, int]] = []
        if not a.empty and not b.empty:
            sets = [s.astype(np.int64) for s in b["hashes"]]
            sizes = np.array([len(s) for s in sets])
            every, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
            nodes, roots = b["node"].to_numpy(), b["root"].to_numpy().copy()
            of = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
            for node, mine in zip(a["node"], a["hashes"], strict=True):
                mine = np.asarray(mine, np.int64)
                shared = np.add.reduceat(np.isin(every, mine).astype(np.int64), starts)
                good = shared * whole >= (sizes + len(mine) - shared) * part
                own = of.get(node, a["root"].to_numpy()[a["node"].to_numpy() == node][0])
                for other in np.unique(roots[good]):
                    if other != own:
                        found.append((int(node), int(nodes[good & (roots == other)][0])))
                        roots[roots == other] = own
                of = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return blocks.applyInPandas(linked, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, locator, n_shingles, component_id, first), one row per input row.

    Documents are linked when their shingle sets' intersection is at least
    ``similarity`` (a fraction) of their union; ``component_id`` is the smallest
    doc_id reachable over links. ``first`` marks one row of each component: the
    smallest doc_id, of rows repeated with that doc_id the first in place. A text
    with fewer words is one shingle; null, empty and blank texts have no
    shingles, are linked with nothing, and have their own doc_id as component.
    A null doc_id is never a component's, unless it has no other. An empty table
    gives an empty result. Texts of any length are compared whole; other columns
    are not looked at.
    """
    with_rows, locator = located(docs)
    return _near_duplicates(with_rows, locator, id_col, text_col, words, similarity)


def _near_duplicates(with_rows: DataFrame, locator: str, id_col: str, text_col: str, words: int, similarity: tuple[int, int]) -> DataFrame:
    """:func:`near_duplicates` over rows that have their locators."""
    graph = _Graph(with_rows, text_col, locator, words, similarity)
    signed = graph.signed(with_rows, id_col, locator, text_col)
    keys = graph.nodes.select(F.explode("keys").alias("key"), "node")
    shared = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-keys")
    members = materialize(salted_join(keys, "key", "node", shared, shared), "members")
    graph.against_leaders(members.withColumn("root", F.col("node")), 0)
    if graph.links is None:
        graph.add(members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    left = materialize(graph.roots(members.where("n > 2")), "left")  # of two members the one pair is done
    graph.all_pairs(left.where(F.col("n") <= SMALL))
    large = left.where(F.col("n") > SMALL)
    if not large.isEmpty():
        graph.against_leaders(large, 1)
        graph.across(graph.roots(large.drop("root")))
    # Many rows may share a node, and many nodes a root.
    count = lambda rows, key: rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rows = signed.select("doc_id", "locator", F.col("n").alias("n_shingles"), "node")
    placed = materialize(salted_join(rows, "node", "locator", components(graph.links), count(rows, "node"), "left").withColumn("root", F.coalesce("root", "node")), "placed")
    some = placed.where("n_shingles > 0")
    least = some.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "locator")).alias("one"))
    joined = salted_join(some, "root", "locator", least, count(some, "root")).select("doc_id", "locator", "n_shingles", F.col("one.doc_id").alias("component_id"), (F.col("locator") == F.col("one.locator")).alias("first"))
    alone = placed.where("n_shingles = 0").select("doc_id", "locator", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return joined.unionByName(alone)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs`` with one row of each component of near duplicates, columns unchanged.

    The first in the sense of :func:`near_duplicates` stays; null and blank texts
    all stay; of rows repeated whole one stays. An empty table stays empty;
    columns of any name are kept.
    """
    with_rows, locator = located(docs)
    dropped = materialize(_near_duplicates(with_rows, locator, id_col, text_col, words, similarity).where("NOT first").select(F.col("locator").alias(locator)), "near-dropped")
    return with_rows.join(bounded_broadcast(dropped), locator, "left_anti").select(*docs.columns)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document: 3 words, similarity 0.85."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, similarity=(85, 100))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: The same by brute force; for small tables.
OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p WHERE 100 * c >= 85 * (na + nb - c)),
r(id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT doc_id, len(sh) AS n_shingles, root AS component_id, doc_id = root AS kept FROM s JOIN c ON c.id = doc_id
"""
