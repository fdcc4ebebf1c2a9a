"""MinHash near-duplicate documents with circulant signatures.

A text becomes the set of its distinct word shingles. A first permutation places each hashed
shingle in a universe of 2^20 positions; coordinate k of the signature is the minimum of a
second permutation, shifted circularly by k, over those positions. Two permutations thus
give all coordinates: a shingle at position p contributes the run [p, p + K) of the second
one. 32 bands of 4 coordinates find a pair of similarity 0.8 but for 5 in 10^8.

Texts with equal sets are one class, met by digest before anything else. Classes that share a
band are candidates; of these no pair list is made. In each bucket all members are
compared with the smallest id first; links found so make components, and then only members
that are outside their leader's component are compared with the rest of their group.
Large groups are split into blocks of ``BLOCK`` members by ``BLOCK`` probes. A comparison
looks at 128-byte sketches first (a pair of similarity 0.8 passes but for about 1 in 10^8)
and then takes the exact Jaccard similarity of the full sets.

Defined results: null and empty texts, and texts without words, have an empty set and are
linked with nothing; a text with fewer words than a shingle has one shingle, the whole
sequence; a row without an id takes no part and is kept; rows that share an id are one
document with all their links; other columns of the input do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleframe.llm import textkit
from candleframe.llm.common import written

BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
UNIVERSE = 1 << 20
#: Members, and probes, that one comparison task holds at once.
BLOCK = 256
#: Equal sketch bytes, of 128, from which a pair is verified: 5.6 standard deviations below the mean at similarity 0.8.
SKETCH_LEAST = 77

_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        rng = np.random.Generator(np.random.PCG64(12345))
        place, order = (rng.permutation(UNIVERSE).astype(np.int32) for _ in range(2))
        around = np.concatenate([order, order[: COORDINATES - 1]])
        _TABLES.extend([place, np.lib.stride_tricks.sliding_window_view(around, COORDINATES)])
    return _TABLES


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates for a set of hashed shingles that is not empty."""
    place, runs = _tables()
    at = place[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    out = np.full(COORDINATES, UNIVERSE, dtype=np.int32)
    for k in range(0, len(at), 2048):
        np.minimum(out, runs[at[k : k + 2048]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; equal bands at different places get different keys."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for part in sig.reshape(BANDS, ROWS).T:
        key = textkit.mix(key ^ textkit.mix(part.astype(np.uint64) + np.uint64(1)))
    return key.view(np.int64)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """id, size of the set, digest of the set, band keys and sketch; the last three null for an empty set."""

    def run(batches):
        for batch in batches:
            sizes, digests, bands, sketches = [], [], [], []
            for _, hashes in textkit.each_text(batch.column(1)):
                s = textkit.shingles(hashes, words)
                sizes.append(len(s))
                sig = signature(s) if len(s) else None
                digests.append(digest(s) if len(s) else None)
                bands.append(band_keys(sig) if len(s) else None)
                sketches.append((sig & 255).astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["id", "n", "digest", "bands", "sketch"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, digest binary, bands array<long>, sketch binary")


def full_sets(df: DataFrame, key: str, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """id and sorted 64-bit shingle hashes (binary) of the documents in ``wanted`` (id, digest)."""

    def run(batches):
        for batch in batches:
            ids, sets = [], []
            expect, own = batch.column(2).to_pylist(), batch.column(0).to_pylist()
            for k, hashes in textkit.each_text(batch.column(1)):
                s = textkit.shingles(hashes, words)
                if digest(s) == expect[k]:
                    ids.append(own[k])
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "payload"])

    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(wanted, "id")
    return texts.mapInArrow(run, "id long, payload binary")


def _sketch_hits(members: list[bytes], probe: bytes) -> np.ndarray:
    rows = np.frombuffer(b"".join(members), dtype=np.uint8).reshape(len(members), -1)
    return (rows == np.frombuffer(probe, dtype=np.uint8)).sum(axis=1) >= SKETCH_LEAST


def set_hits(percent: int) -> Callable:
    """Which members have the exact Jaccard similarity with a probe, through one sorted index of the block."""

    def index(members: list[bytes]):
        size = np.array([len(m) // 8 for m in members])
        value = np.frombuffer(b"".join(members), dtype=np.uint64)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], np.repeat(np.arange(len(members)), size)[order]

        def hits(probe: bytes) -> np.ndarray:
            p = np.frombuffer(probe, dtype=np.uint64)
            low, high = np.searchsorted(value, p, "left"), np.searchsorted(value, p, "right")
            run = high - low
            at = np.repeat(low - (np.cumsum(run) - run), run) + np.arange(run.sum())
            shared = np.bincount(owner[at], minlength=len(members))
            return 100 * shared >= percent * (size + len(p) - shared)

        return hits

    return index


def _groups(batches) -> Iterator[tuple[int, list, list]]:
    """Consecutive rows of one task key: (group, members, probes) with (id, tag, payload) each."""
    now, held = None, ([], [])
    for batch in batches:
        c = [batch.column(k).to_pylist() for k in range(7)]
        for g, block, chunk, probe, i, tag, payload in zip(*c, strict=True):
            if (g, block, chunk) != now:
                if now is not None:
                    yield now[0], *held
                now, held = (g, block, chunk), ([], [])
            held[probe].append((i, tag, payload))
    if now is not None:
        yield now[0], *held


def in_blocks(members: DataFrame, probes: DataFrame, payloads: DataFrame) -> DataFrame:
    """Deal members and probes (g, id, tag) of each group out to blocks, with their payloads, sorted by block."""
    size = members.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    size = size.join(probes.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks")), "g")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    m = members.join(size, "g").select("g", own("blocks").alias("block"), every("chunks").alias("chunk"), F.lit(0).alias("probe"), "id", "tag")
    p = probes.join(size, "g").withColumn("chunk", own("chunks")).select("g", every("blocks").alias("block"), "chunk", F.lit(1).alias("probe"), "id", "tag")
    rows = m.unionByName(p).join(payloads.select("id", "payload"), "id").select("g", "block", "chunk", "probe", "id", "tag", "payload")
    return rows.repartition("g", "block", "chunk").sortWithinPartitions("g", "block", "chunk", "probe", "id")


def alike(members: DataFrame, probes: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) between probes and members of the same group whose tags differ.

    For each probe and tag a block yields one link at most; the others would join the same components.
    """

    def near(batches):
        for g, held, asking in _groups(batches):
            keep: set[tuple] = set()
            if held and asking:
                payloads = [m[2] for m in held]
                for u, tag, payload in asking:
                    for k in np.flatnonzero(_sketch_hits(payloads, payload)).tolist():
                        if held[k][1] != tag:
                            keep.add((0, held[k][0], held[k][1]))
                            keep.add((1, u, tag))
            rows = sorted(keep)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64())))], names=["g", "probe", "id", "tag"])

    index = set_hits(percent)

    def exact(batches):
        for _, held, asking in _groups(batches):
            a, b = [], []
            if held and asking:
                hits = index([m[2] for m in held])
                for u, tag, payload in asking:
                    found: dict[int, int] = {}
                    for k in np.flatnonzero(hits(payload)).tolist():
                        if held[k][1] != tag:
                            found.setdefault(held[k][1], held[k][0])
                    a.extend([u] * len(found))
                    b.extend(found.values())
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    kept = written(in_blocks(members, probes, sketches).mapInArrow(near, "g long, probe int, id long, tag long").distinct(), "minhash-near")
    side = lambda k: kept.filter(F.col("probe") == k).select("g", "id", "tag")
    return written(in_blocks(side(0), side(1), sets).mapInArrow(exact, "a long, b long").distinct(), "minhash-links")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); a component is named by its smallest id.

    Labels spread to neighbours and then jump to the label's own label, until none changes;
    each round is written to the shared folder, only the number of changes comes back.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "minhash-both")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "minhash-labels")
    while True:
        spread = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        moved = labels.join(spread, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        moved = moved.join(jump, "component", "left").select("id", "old", F.least("component", "further").alias("component"))
        moved = written(moved, "minhash-labels")
        changed = moved.filter(F.col("old") != F.col("component")).count()
        labels = moved.select("id", "component")
        if not changed:
            return labels


def near_duplicates(df: DataFrame, key: str, text: str, words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``df``: id, n_shingles, component_id (smallest linked id), kept."""
    table = written(signatures(df, key, text, words), "minhash-signatures")
    full = table.filter(F.col("digest").isNotNull() & F.col("id").isNotNull())
    classes = full.groupBy("digest").agg(F.min("id").alias("class"))
    reps = full.join(classes, [full["digest"] == classes["digest"], full["id"] == classes["class"]], "left_semi")
    reps = written(reps.dropDuplicates(["id", "digest"]).select("id", "digest", "bands", F.col("sketch").alias("payload")), "minhash-classes")

    rows = reps.select(F.explode("bands").alias("band"), "id")
    leaders = rows.groupBy("band").agg(F.min("id").alias("leader"), F.max("id").alias("last")).filter("leader != last")
    buckets = written(rows.join(leaders.select("band", "leader"), "band").select("leader", "id").distinct(), "minhash-buckets")
    sketches = reps.select("id", "payload")
    wanted = reps.select("id", "digest").join(buckets.select("id").distinct(), "id")
    sets = written(full_sets(df, key, text, words, wanted), "minhash-sets")

    tagged = lambda rows, g, i, tag: rows.select(F.col(g).alias("g"), F.col(i).alias("id"), F.col(tag).alias("tag")).distinct()
    links = alike(tagged(buckets.filter("id != leader"), "leader", "id", "id"), tagged(buckets, "leader", "leader", "leader"), sketches, sets, percent)
    found = components(links)
    named = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"{c}_component"))
    mates = buckets.join(named("leader"), "leader", "left").join(named("id"), "id", "left")
    mates = mates.select("id", F.coalesce("leader_component", "leader").alias("g"), F.coalesce("id_component", "id").alias("tag"))
    mates = written(mates.distinct(), "minhash-mates")
    more = alike(tagged(mates, "g", "id", "tag"), tagged(mates.filter("g != tag"), "g", "id", "tag"), sketches, sets, percent)
    several = full.groupBy("id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).filter("first != last").select("id")
    same_id = full.join(several, "id").join(classes, "digest").filter(F.col("id") != F.col("class")).select(F.col("id").alias("a"), F.col("class").alias("b"))
    found = components(links.union(more).union(same_id))

    classes = classes.join(found, classes["class"] == found["id"], "left").select("digest", F.coalesce("component", "class").alias("component"))
    out = table.select("id", F.col("n").alias("n_shingles"), "digest").join(classes, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
