"""Near-duplicate documents by a multi-index Hamming join over MinHash signatures.

A document's set holds the hashes of its distinct shingles of ``words`` words (``WORDS`` unless asked
otherwise). Documents with equal sets are one
class; each class has a signature of ``LANES`` lanes, each a 32-bit digest of a minimum. Two sets of
similarity 0.8 differ in a lane with probability 0.2, so in more than ``DISTANCE`` of 48 lanes with
one of about a millionth. The signature is split into chunks of ``CHUNK`` lanes: if two signatures
differ in DISTANCE lanes at most, then by the pigeonhole principle they differ in one lane at most of
some chunk. Each chunk is indexed once for each lane that may be wrong, so that all pairs under the
distance share a key.

Within a key's bucket, every class is compared with the bucket's smallest: as many comparisons as
there are rows. Signatures come first (distance, and sizes that allow the similarity), full sets
confirm what they leave. That may miss links between two that aren't both linked to the smallest, so
the classes of buckets of three or more in which a comparison failed are looked at once more: a prefix
filter on lanes leaves those that may be within the distance of another component's, and a prefix
filter on their shingles joins them (rarest first, so that passages that many documents share stay
out of it). Classes that are already in one component aren't compared again. All links are confirmed
on full sets; no bucket, partner or candidate is capped.

Nulls: a null text has no words; a null doc_id is its own component (null). Texts without words:
an empty set, linked with nothing. Fewer words than a shingle's: the whole sequence is the one shingle. Very
long texts: whole. Repeated rows: equal sets, linked; rows of one doc_id are one document. Empty
tables: empty result. Other columns are not read by ``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import stored
from stemma.llm.segments import slices
from stemma.llm.shingles import MOST_WORDS, MinHash, mix, shingle_set

#: Words of a shingle.
WORDS = 5
#: Similarity from which documents are linked, in hundredths.
SIMILARITY = 80
LANES, CHUNK = 48, 4
#: Lanes in which two signatures may differ: then one chunk at least has three equal lanes.
DISTANCE = 2 * (LANES // CHUNK) - 1


def chunk_keys(lanes: np.ndarray) -> np.ndarray:
    """For each row of lanes, a key for every chunk and every lane of it that is left out."""
    keys = []
    wide = lanes.astype(np.uint64)
    for chunk in range(lanes.shape[1] // CHUNK):
        for wrong in range(CHUNK):
            h = np.full(len(lanes), chunk * CHUNK + wrong + 1, np.uint64)
            for k in range(CHUNK):
                if k != wrong:
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + wide[:, chunk * CHUNK + k])
            keys.append(h)
    return np.stack(keys, 1)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (size of the set), two sums over the set that tell sets apart, and the lanes as bytes."""
    hasher = MinHash(LANES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in slices(batch.column("text")):
                part = batch.slice(at, rows)
                sets = [shingle_set(t, words) for t in part.column("text").to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                lanes = np.zeros((len(sets), LANES), np.uint32)
                if full:
                    lanes[full] = hasher([sets[i] for i in full])
                columns = (
                    [*map(len, sets)],
                    [int(s.sum().astype(np.int64)) for s in sets],
                    [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().astype(np.int64)) for s in sets],
                )
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array([x.tobytes() for x in lanes], pa.binary())], names=["doc_id", "n", "f1", "f2", "lanes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, lanes binary")


def lane_rows(raw: Sequence[bytes]) -> np.ndarray:
    """Signatures, a row each."""
    return np.frombuffer(b"".join(raw), np.uint32).reshape(-1, LANES)


def exploded(classes: DataFrame, made: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, key) for each number that ``made`` has for the signature of a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = made(lane_rows(batch.column("lanes").to_pylist())).view(np.int64)
            ids = np.repeat(batch.column("id").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.ravel())], names=["id", "key"])

    return classes.select("id", "lanes").mapInArrow(run, "id long, key long")


def lane_values(lanes: np.ndarray) -> np.ndarray:
    """A number for each lane and its value."""
    return mix(lanes.astype(np.uint64) | (np.arange(1, LANES + 1, dtype=np.uint64) << np.uint64(32)))


def close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``pairs`` (a, b) whose signatures are within DISTANCE and whose sizes allow the similarity."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.loc[(lane_rows(frame["x"]) != lane_rows(frame["y"])).sum(1) <= DISTANCE, ["a", "b"]]

    one, two = (classes.select(F.col("id").alias(i), F.col("n").alias(n), F.col("lanes").alias(x)) for i, n, x in (("a", "na", "x"), ("b", "nb", "y")))
    sized = 100 * F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb")
    return pairs.join(one, "a").join(two, "b").where(sized).select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id and the set, as the bytes of its sorted hashes, of the documents in ``ids``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"].to_numpy(), "elements": [shingle_set(t, words).tobytes() for t in frame["text"]]})

    found = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
    return found.mapInPandas(run, "id long, elements binary")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``both`` and ``either``, the sizes of intersection and union of their sets."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both, either = [], []
            for x, y in zip(frame["x"], frame["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                n = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                both.append(n)
                either.append(len(x) + len(y) - n)
            yield pd.DataFrame({"a": frame["a"].to_numpy(), "b": frame["b"].to_numpy(), "both": both, "either": either})

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInPandas(run, "a long, b long, both long, either long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b) those whose full sets reach the similarity."""
    found = compared(pairs, sets)
    return stored(found.where(100 * F.col("both") >= SIMILARITY * F.col("either")).select("a", "b"), "links")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of the ends of ``links`` (a, b): the smallest id that is reachable.

    Large-star and small-star steps by turns until nothing changes; every step is stored.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "links")

    def step(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not large:
            both = both.where("v < u")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.where("v > u") if large else both
        out = moved.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = None
    while before != (now := state(edges)):
        before = now
        edges = stored(step(stored(step(edges, True), "links"), False), "links")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def with_component(df: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """``df`` with the component of its column ``on``: itself where it has no links."""
    return df.join(found.withColumnRenamed("id", on), on, "left").withColumn("component", F.coalesce("component", on))


def common_values(prefix: DataFrame) -> DataFrame:
    """(e, major) of the values in ``prefix`` (e, component) that several components have, and the component with the most rows.

    Stored, so that the join with ``prefix`` sees its size: it is broadcast where that is small, and split where a value is hot.
    """
    sizes = prefix.groupBy("e", "component").agg(F.count("*").alias("c"))
    found = sizes.groupBy("e").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("k")).where("k > 1")
    return stored(found.select("e", F.col("m.component").alias("major")), "common")


def near_by_lanes(left: DataFrame, found: DataFrame) -> DataFrame:
    """The ids of ``left`` that may be within DISTANCE of one in another component, by the prefix filter on lanes.

    Of two that agree in LANES - DISTANCE lanes or more, any choice of DISTANCE + 1 lanes of each in
    one order must meet. Values that no other class has come first and meet nothing.
    """
    elements = exploded(left, lane_values).withColumnRenamed("key", "e")
    counts = elements.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    placed = elements.join(counts, "e").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"))  # LANES at most
    length = F.greatest(F.lit(DISTANCE + 1 - LANES) + F.size("es"), F.lit(0))
    prefix = placed.select("id", F.explode(F.slice("es", F.lit(1), length)).alias("x")).select("id", "x.e")
    prefix = stored(with_component(prefix, found, "id"), "lanes")
    return stored(prefix.join(common_values(prefix), "e").select("id").distinct(), "left")


def prefix_pairs(sets: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that may reach the similarity, by the prefix filter on shingles.

    Of two sets of similarity s or more, any choice of n - ceil(s n) + 1 elements of each in one order
    must meet, at places that leave enough elements for the similarity. Rarest first; those that no
    other set has only count. In an element's list, the component with the most members is not paired
    with itself.
    """

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, raw in zip(frame["id"], frame["elements"], strict=True):
                s = np.frombuffer(raw, np.int64)
                for at in range(0, len(s), 10_000):
                    part = s[at : at + 10_000]
                    yield pd.DataFrame({"id": np.full(len(part), i), "n": len(s), "e": part})

    elements = sets.mapInPandas(split, "id long, n long, e long")
    counts = elements.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    placed = elements.join(counts, "e").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"))  # of one document
    alone = F.col("n") - F.size("es")
    length = F.greatest((F.col("n") - F.ceil(F.col("n") * SIMILARITY / 100) + 1 - alone).cast("int"), F.lit(0))
    prefix = placed.select("id", "n", alone.alias("alone"), F.posexplode(F.slice("es", F.lit(1), length)).alias("pos", "x"))
    prefix = prefix.select("id", "n", "x.e", (F.col("n") - F.col("alone") - F.col("pos")).alias("rest"))
    prefix = stored(with_component(prefix, found, "id"), "prefix")
    marked = stored(prefix.join(common_values(prefix), "e"), "marked")  # both sides of the next join are plain shuffles, which are split where a value is hot
    one = marked.where("component <> major").select("e", F.col("id").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"), F.col("component").alias("ca"))
    two = marked.select("e", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"), F.col("component").alias("cb"), "major")
    near = ((100 + SIMILARITY) * F.least("ra", "rb") >= SIMILARITY * (F.col("na") + F.col("nb"))) & (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("major")) | (F.col("a") < F.col("b")))
    return one.join(two, "e").where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that is reachable) and kept, for each row of ``docs``."""
    if not 1 <= words <= MOST_WORDS:
        raise ValueError(f"a shingle has 1 to {MOST_WORDS} words, not {words}")
    base = stored(signatures(docs, words), "signatures")
    classes = base.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("id"), F.min_by("lanes", "doc_id").alias("lanes"))
    classes = stored(classes, "classes")
    keyed = exploded(classes, chunk_keys)
    buckets = keyed.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("c")).where("c > 1")
    members = stored(keyed.join(buckets, "key").where("id <> a"), "members")  # of a bucket, all but the smallest
    pairs = stored(members.select("a", F.col("id").alias("b")).distinct(), "pairs")
    near = stored(close(pairs, classes), "close")
    ids = stored(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    links = confirmed(near, stored(full_sets(docs, ids, words), "sets"))
    found = components(links)
    # what is left: of buckets of three or more in which a comparison failed, all but the smallest
    failed = pairs.join(links, ["a", "b"], "left_anti").withColumnRenamed("b", "id")
    open_keys = members.where("c > 2").join(failed, ["a", "id"], "left_semi").select("key").distinct()
    left = members.where("c > 2").join(open_keys, "key", "left_semi").select("id").distinct()
    left = near_by_lanes(classes.join(left, "id", "left_semi"), found)
    sets = stored(full_sets(docs, left, words), "sets")
    more = confirmed(prefix_pairs(sets, found), sets)
    same = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
    found = components(same.unionByName(more))
    whole = base.join(classes.drop("lanes"), ["n", "f1", "f2"], "left").withColumn("id", F.when(F.col("n") > 0, F.col("id")))
    whole = with_component(whole.withColumn("id", F.coalesce("id", "doc_id")), found, "id")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component."""
    # stored, so of a known size: where it is small, no text is shuffled
    gone = stored(near_duplicates(docs, words).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
