"""Near-duplicate components by one-permutation MinHash with optimal densification.

A document's set of w-word shingles is hashed once; bin k of the signature holds the least hash of its range, and an
empty bin borrows from a non-empty one that its own fixed probe sequence names. Bands of the signature give buckets.
Documents with equal sets are first merged into classes. In each bucket only a star of candidate edges is made, from its
least document to the others; links are confirmed on full sets. A star alone can miss a link between two leaves. So the
buckets of one centre whose members still lie in different components form a group, and all its pairs of different
components are compared exactly, but without rows for pairs: members outside the group's largest component are dealt into
tiles of bounded size with an inverted index of their shingles, every member streams past each tile, and a tile gives out
only links that join components it has not joined yet.

Cases: null or empty texts and texts without words have an empty set and are linked with nothing; a null doc_id is
linked with nothing and kept; rows that repeat a doc_id count as one document; texts with fewer than w words are one
shingle; a very long text is one set like any other; ties go to the smallest doc_id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.llm.common import discard, give_back, hot_keys, materialize, mix, spread_join, token_hashes, words
from korpusflow.llm.components import connected_components

BANDS, ROWS = 32, 5
PROBES = 512
#: Members that are compared with one copy of a centre's text.
GROUP = 256
#: A group's indexed members and those that stream past them are dealt alike to about TILES tiles, of so many members at
#: least and at most; a tile's shingles are bounded too. So small groups are spread out, and of large ones neither side
#: goes out much more often than the other.
TILES, LEAST_TILE, TILE_MEMBERS, TILE_SHINGLES = 36, 384, 4096, 2_000_000
FEATURES = "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>"


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    flat, ends = words(texts)
    h = token_hashes(flat)
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D)]
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for k in range(size):
            rolled += h[k : k + len(rolled)] * odd[k % 8] + np.uint64(k)
        rolled = mix(rolled)
        sets = []
        for a, b in zip(ends, ends[1:]):
            if b - a >= size:
                sets.append(np.unique(rolled[a : b - size + 1]))
            elif b > a:
                whole = np.uint64(b - a)
                for k in range(b - a):
                    whole = whole * odd[5] + h[a + k] * odd[k % 8]
                sets.append(mix(np.array([whole], np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


class Signer:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, n = bands, rows, bands * rows
        self.lows = np.array([(k << 64) // n for k in range(n)], np.uint64)
        self.probes = np.random.default_rng(20240229).integers(0, n, (n, PROBES))
        with np.errstate(over="ignore"):
            self.spread = mix(np.arange(1, n + 1, dtype=np.uint64)).reshape(bands, rows) | np.uint64(1)
            self.band_no = mix(np.arange(1001, 1001 + bands, dtype=np.uint64))

    def signature(self, sorted_set: np.ndarray) -> np.ndarray:
        n = len(self.lows)
        first = np.searchsorted(sorted_set, self.lows)
        filled = np.diff(np.append(first, len(sorted_set))) > 0
        out = np.zeros(n, np.uint64)
        out[filled] = sorted_set[first[filled]]
        if not filled.all():
            empty = np.flatnonzero(~filled)
            hit = filled[self.probes[empty]]
            at = hit.argmax(axis=1)
            source = self.probes[empty, at]
            for j in np.flatnonzero(~hit[np.arange(len(empty)), at]):  # no probe met a full bin: scan on from the last one
                order = (self.probes[empty[j], -1] + np.arange(n)) % n
                source[j] = order[filled[order].argmax()]
            out[empty] = out[source]
        return out

    def buckets(self, sorted_set: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            rows = self.signature(sorted_set).reshape(self.bands, self.rows)
            return mix((mix(rows) * self.spread).sum(axis=1, dtype=np.uint64) + self.band_no).view(np.int64)


def features(df: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def run(batches):
        give_back()
        signer = Signer(bands, rows)
        for batch in batches:
            sets = shingle_sets(batch.column(1), size)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            marks = [signer.buckets(s) if len(s) else np.zeros(0, np.int64) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(m) for m in marks])]).astype(np.int32)
            flat = pa.array(np.concatenate(marks) if marks else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.ListArray.from_arrays(pa.array(ends), flat)],
                ["doc_id", "n_shingles", "key1", "key2", "bands"],
            )

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FEATURES)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union. Members of a centre go to groups of
    bounded size, each with one copy of the centre's text; a task streams over its groups and holds one centre."""
    pairs = materialize(pairs, "minhash-star")
    counts = materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "minhash-centres")
    dealt = spread_join(pairs, counts, ["a"], hot_keys(counts, ["a"]), F.xxhash64("b", F.lit(5))).select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / GROUP)).alias("part"))
    centres = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(0).alias("role"), F.col("a").alias("b"), "text")
    members = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "part", F.lit(1).alias("role"), "b", "text")
    rows = centres.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def run(batches):
        give_back()
        centre, sets_of_centre = None, []
        for batch in batches:
            a, part, role, b = (np.asarray(batch.column(k)) for k in range(4))
            found = []
            for i, mine in enumerate(shingle_sets(batch.column(4), size)):
                if role[i] == 0:
                    sets_of_centre = [*sets_of_centre, mine] if centre == (a[i], part[i]) else [mine]  # rows may repeat an id
                    centre = a[i], part[i]
                elif any(similar(s, mine, percent) for s in sets_of_centre):
                    found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(b[found])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    if len(s) > len(t):
        s, t = t, s
    if 100 * len(s) < percent * len(t) or not len(s):
        return False
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    both = int((t[at] == s).sum())
    return 100 * both >= percent * (len(s) + len(t) - both)


def cross_links(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of each group of (centre, rep, n, component) members, as if every pair of
    different components in a group had been compared."""
    members = materialize(members, "minhash-members")
    by_component = members.groupBy("centre", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    groups = by_component.groupBy("centre").agg(F.max_by("component", F.struct("k", "component")).alias("largest"), F.sum("k").alias("m"), F.sum("s").alias("s"), F.max(F.struct("k", "component", "s")).alias("top"), F.count(F.lit(1)).alias("c"))
    groups = groups.withColumn("u", F.col("m") - F.col("top.k"))
    side = F.greatest(F.lit(LEAST_TILE), F.least(F.lit(TILE_MEMBERS), F.ceil(F.sqrt(F.col("m").cast("double") * F.col("u") / TILES))))
    tiles = F.greatest(F.lit(1), F.ceil(F.col("u") / side), F.ceil((F.col("s") - F.col("top.s")) / TILE_SHINGLES))
    groups = groups.filter("c > 1").select("centre", "largest", "m", tiles.cast("int").alias("tiles"), F.greatest(F.lit(1), F.ceil(F.col("m") / side)).cast("int").alias("parts"))
    groups = materialize(groups, "minhash-groups")
    dealt = spread_join(members, groups.drop("m"), ["centre"], hot_keys(groups, ["centre"], "m"), F.xxhash64("rep", F.lit(5)))
    tile, part = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    indexed = dealt.filter("component <> largest").select("centre", tile.alias("tile"), every("parts").alias("part"), F.lit(0).alias("role"), "rep", "component")
    passing = dealt.select("centre", every("tiles").alias("tile"), part.alias("part"), F.lit(1).alias("role"), "rep", "component")
    key = ["centre", "tile", "part"]
    rows = indexed.unionByName(passing).join(texts.withColumnRenamed("id", "rep"), "rep").select(*key, "role", "rep", "component", "text")
    rows = rows.repartition(*key).sortWithinPartitions(*key, "role", "rep")

    def run(batches):
        give_back()
        now, tile = None, None
        for batch in batches:
            places = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            role, rep, component = (np.asarray(batch.column(k)) for k in (3, 4, 5))
            found = []
            for i, mine in enumerate(shingle_sets(batch.column(6), size)):
                if places[i] != now:
                    now, tile = places[i], Tile(percent)
                if role[i] == 0:
                    tile.add(int(rep[i]), int(component[i]), mine)
                else:
                    found += tile.links(int(rep[i]), int(component[i]), mine)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return materialize(rows.mapInArrow(run, "a long, b long").distinct(), "minhash-links")


class Tile:
    """Indexed members of a group, and the components that links have joined so far."""

    def __init__(self, percent: int):
        self.percent, self.reps, self.components, self.sets, self.parent, self.index = percent, [], [], [], {}, None

    def add(self, rep: int, component: int, mine: np.ndarray):
        self.reps.append(rep)
        self.components.append(component)
        self.sets.append(mine)

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            x = up
        return x

    def links(self, rep: int, component: int, mine: np.ndarray) -> list[tuple[int, int]]:
        if not self.sets:
            return []
        if self.index is None:
            every, owner = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
            by = np.argsort(every, kind="stable")
            shingles, starts = np.unique(every[by], return_index=True)
            self.index = shingles, np.append(starts, len(every)), owner[by]
            self.sizes = np.array([len(s) for s in self.sets])
        shingles, starts, owner = self.index
        at = np.minimum(np.searchsorted(shingles, mine), len(shingles) - 1)
        at = at[shingles[at] == mine]
        counts = np.diff(starts)[at]
        if not counts.sum():
            return []
        ends = np.cumsum(counts)
        entries = np.arange(ends[-1]) + np.repeat(starts[at] - (ends - counts), counts)
        both = np.bincount(owner[entries], minlength=len(self.sets))
        out = []
        for j in np.flatnonzero((both > 0) & (100 * both >= self.percent * (len(mine) + self.sizes - both))):
            x, y = self.root(component), self.root(self.components[j])
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                if rep != self.reps[j]:
                    out.append((min(rep, self.reps[j]), max(rep, self.reps[j])))
        return out


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id), for every
    row of (doc_id, text). Links: 100 * intersection >= percent * union of the sets of `size`-word shingles."""
    f = materialize(features(df, size, bands, rows), "minhash-features")
    linkable = f.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(linkable.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "minhash-classes")
    heads = linkable.join(classes.select("key1", "key2", F.col("rep").alias("doc_id")), ["key1", "key2", "doc_id"], "left_semi")
    entries = heads.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    head = F.min(F.struct("rep", "n")).alias("head")
    shared = entries.groupBy("bucket").agg(head, F.max("rep").alias("last"), F.count(F.lit(1)).alias("entries")).filter("head.rep < last")
    shared = materialize(shared.select("bucket", F.col("head.rep").alias("centre"), F.col("head.n").alias("cn"), "entries"), "minhash-shared")
    in_bucket = spread_join(entries, shared.drop("entries"), ["bucket"], hot_keys(shared, ["bucket"], "entries"), F.xxhash64("rep"))
    open_buckets = materialize(in_bucket, "minhash-buckets")
    sizes_fit = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    ids = open_buckets.select(F.col("rep").alias("id")).distinct()
    texts = df.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    texts = materialize(texts.join(ids.hint("merge"), "id", "left_semi"), "minhash-texts")  # of candidates only

    star = open_buckets.filter("rep > centre").filter(sizes_fit(F.col("n"), F.col("cn"))).select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    links = confirmed(star, texts, size, percent)
    # A doc_id with several texts is one document: its classes are linked.
    repeated = linkable.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    hot = hot_keys(classes, ["key1", "key2"], "copies")
    of_id = spread_join(linkable.join(repeated, "doc_id", "left_semi"), classes, ["key1", "key2"], hot, F.xxhash64("doc_id")).select("doc_id", "rep").distinct()
    of_id = materialize(of_id, "minhash-repeated")
    if not of_id.isEmpty():
        least = materialize(of_id.groupBy("doc_id").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n")), "minhash-least")
        tied = spread_join(of_id, least.drop("n"), ["doc_id"], hot_keys(least, ["doc_id"]), F.xxhash64("rep"))
        links = links.unionByName(tied.filter("rep > a").select("a", F.col("rep").alias("b")).distinct())
    links = materialize(links, "minhash-links")
    labels = connected_components(links)
    members = open_buckets.select("centre", "rep", "n").distinct().join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    found = cross_links(members, texts, size, percent)
    discard(labels)
    labels = connected_components(links.unionByName(found))

    by_class = classes.join(labels.select(F.col("node").alias("rep"), F.col("component")), "rep", "left").select("key1", "key2", F.coalesce("component", "rep").alias("component"))
    by_class = materialize(by_class, "minhash-components")
    discard(shared, open_buckets, texts, links, found, labels)
    placed = spread_join(linkable.select("doc_id", "n_shingles", "key1", "key2"), by_class, ["key1", "key2"], hot, F.xxhash64("doc_id")).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = f.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
