"""N-gram Jaccard join by vertical partitioning.

The global order of all n-grams is that of their 64-bit values, cut into
fragments. A fragment holds each document's n-grams of its range, and knows by
itself which of them other documents have as well. Its partial counts, summed
per document, leave the documents that can reach the threshold at all. Pairs
of those come from the rarest n-grams that a pair must share one of; their
overlaps are counted part by part and summed per pair.

Equal sets are one vertex. Only what decides membership is verified: first
each n-gram's group against one member, then what is still in another
component. So a group of thousands of near copies is never paired out, and no
link that joins two components is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from waymark.llm.common import byte_class, joined_words, shingle_values, stage, text_batches

#: Words are runs of all but ASCII white space.
WORDS = byte_class([(0x09, 0x0D), (0x20, 0x20)])
N = 5
PERCENT = 80
FRAGMENT_SHINGLES = 2_000_000
#: Bytes of text per n-gram, to set the number of fragments.
BYTES_PER_SHINGLE = 6
FLUSH_BYTES = 6 << 20
#: Parts in which the overlap of a pair is counted.
PARTS = 8

CUT = "fragment bigint, doc_ids array<bigint>, text_keys array<bigint>, sizes array<int>, vertices binary, counts binary, grams binary"
HELD = "doc_id bigint, text_key bigint, vertex bigint, n int, bucket bigint, vertices array<bigint>, counts array<int>, grams array<bigint>, dfs array<int>"
SETS = "vertex bigint, grams array<bigint>, dfs array<int>"
_GRAM_BITS = 48


def _fragment_row(fragment: int, vertices: np.ndarray, counts: np.ndarray, grams: np.ndarray) -> dict:
    packed = np.ascontiguousarray(grams).view(np.uint8).reshape(-1, 8)[:, :_GRAM_BITS // 8].tobytes()
    return {"fragment": fragment, "vertices": vertices.tobytes(), "counts": counts.astype(np.uint32).tobytes(), "grams": packed}


def _cut(batches: Iterator[pa.RecordBatch], n: int, fragments: int) -> Iterator[pa.RecordBatch]:
    """Each run of documents as one row per fragment, and one with the documents themselves."""
    schema = pa.schema([("fragment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("text_keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("vertices", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary())])
    turn = TaskContext.get().partitionId()
    for rows, texts in text_batches(batches, "text", FLUSH_BYTES):
        values, lengths = joined_words(texts, WORDS)
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        vertices, sizes, held, fresh = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [], {}
        for i in range(len(texts)):
            own = np.unique(shingle_values(values[bounds[i]:bounds[i + 1]], n))
            sizes[i] = len(own)
            if len(own):
                vertices[i] = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)
                if fresh.setdefault(int(vertices[i]), i) == i:
                    held.append(own)
        out = [{"fragment": fragments + turn % fragments, "doc_ids": rows["doc_id"].to_pylist(), "text_keys": rows["text_key"].to_pylist(), "sizes": sizes.tolist(), "vertices": vertices.tobytes()}]
        turn += 1
        if held:
            first = np.fromiter(fresh.values(), np.int64, len(fresh))
            grams = np.concatenate(held)
            owner = np.repeat(np.arange(len(held)), sizes[first])
            where = _range_of(grams, fragments)
            order = np.argsort(where.astype(np.uint16) if fragments <= 1 << 16 else where, kind="stable")
            grams, owner = grams[order], owner[order]
            cuts = np.concatenate(([0], np.cumsum(np.bincount(where, minlength=fragments))))
            for f in np.flatnonzero(np.diff(cuts)):
                own = owner[cuts[f]:cuts[f + 1]]
                begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                out.append(_fragment_row(int(f), vertices[first[own[begin]]], np.diff(np.append(begin, len(own))), grams[cuts[f]:cuts[f + 1]]))
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _range_of(values: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each value when all 64-bit values are cut into so many equal ones."""
    return ((values.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where a sorted array has a new value."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)


def _shared(group: pa.Table, fragments: int) -> pa.Table:
    """Of one fragment, the n-grams that two vertices or more have, with how many have each: a row per range of vertices."""
    lists = pa.list_(pa.int64()), pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("vertex", pa.int64()), ("n", pa.int32()), ("bucket", pa.int64()), ("vertices", lists[0]), ("counts", lists[1]), ("grams", lists[0]), ("dfs", lists[1])])
    fragment = group["fragment"][0].as_py()

    def joined(name: str, type_: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(b, type_) for b in group[name].to_pylist()])

    vertices = joined("vertices", np.int64)
    if fragment >= fragments:
        ids, keys, sizes = (group[name].combine_chunks().flatten() for name in ("doc_ids", "text_keys", "sizes"))
        vertex = pa.array(vertices, pa.int64(), mask=sizes.to_numpy() == 0)
        return pa.Table.from_arrays([ids, keys, vertex, sizes, *(pa.nulls(len(ids), t) for t in schema.types[4:])], schema=schema)

    counts = joined("counts", np.uint32).astype(np.int64)
    raw = np.frombuffer(b"".join(group["grams"].to_pylist()), np.uint8).reshape(-1, _GRAM_BITS // 8)
    grams = np.zeros((len(raw), 8), np.uint8)
    grams[:, :_GRAM_BITS // 8] = raw
    grams = grams.view(np.uint64).ravel()
    _, once = np.unique(vertices, return_index=True)
    alone = np.zeros(len(vertices), bool)
    alone[once] = True
    keep = np.repeat(alone, counts)
    grams, owner = grams[keep], np.repeat(np.arange(len(vertices)), counts)[keep]
    order = np.argsort(grams)
    grams, owner = grams[order], owner[order]
    runs = np.diff(np.append(_starts(grams), len(grams)))
    df = np.repeat(runs, runs)
    many = df > 1
    grams, owner, df = grams[many], owner[many], df[many]
    bucket = _range_of(vertices, fragments)[owner]
    order = np.lexsort((owner, bucket))
    grams, owner, df, bucket = grams[order], owner[order], df[order], bucket[order]
    grams = (grams | np.uint64((fragment & 0x7FFF) << _GRAM_BITS)).view(np.int64)
    first, cut = _starts(owner), _starts(bucket)
    of_gram = pa.array(np.append(cut, len(grams)), pa.int32())
    of_owner = pa.array(np.searchsorted(first, np.append(cut, len(grams))), pa.int32())
    empty = [pa.nulls(len(cut), t) for t in schema.types[:4]]
    return pa.Table.from_arrays([
        *empty, pa.array(bucket[cut]), pa.ListArray.from_arrays(of_owner, pa.array(vertices[owner[first]])), pa.ListArray.from_arrays(of_owner, pa.array(np.diff(np.append(first, len(grams))).astype(np.int32))),
        pa.ListArray.from_arrays(of_gram, pa.array(grams)), pa.ListArray.from_arrays(of_gram, pa.array(df.astype(np.int32))),
    ], schema=schema)


def _sets(group: pa.Table) -> pa.Table:
    """Of one range of vertices, what all fragments hold of each."""
    vertices, counts, grams, dfs = (group[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("vertices", "counts", "grams", "dfs"))
    owner = np.repeat(vertices, counts)
    order = np.argsort(owner, kind="stable")
    owner, first = owner[order], _starts(owner[order])
    ends = pa.array(np.append(first, len(owner)), pa.int32())
    return pa.Table.from_arrays([pa.array(owner[first], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(grams[order], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(dfs[order], pa.int32()))], ["vertex", "grams", "dfs"])


def components(edges: DataFrame) -> DataFrame:
    """vertex and comp, the component's name, for every vertex of the edges (a, b). Names are vertices.

    Each round points every vertex to its smallest neighbour, follows the
    pointers twice and contracts the edges. Vertices are digests, so pointers
    form short paths and a few rounds do. Every round is written.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stage(both, "edges")
    found = stage(both.select(F.col("a").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("comp")), "components")
    while not both.isEmpty():
        to = stage(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("to")), "pointers")
        for _ in range(2):
            onward = to.select(F.col("v").alias("to"), F.col("to").alias("next"))
            to = to.join(onward, "to").select("v", F.col("next").alias("to"))
        to = stage(to, "pointers")
        found = stage(found.join(to.withColumnRenamed("v", "comp"), "comp", "left").select("vertex", F.coalesce("to", "comp").alias("comp")), "components")
        moved = both.join(to.select(F.col("v").alias("a"), F.col("to").alias("a2")), "a").join(to.select(F.col("v").alias("b"), F.col("to").alias("b2")), "b")
        both = stage(moved.select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b").distinct(), "edges")
    return found


def _can_link(percent: int) -> Column:
    """For the first n-gram in the order that two sets share: what both have from there on, as far as sizes allow, reaches the threshold."""
    most = F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place"))
    return (100 + percent) * most >= percent * (F.col("n") + F.col("other_n"))


def _of_part(part: int) -> Column:
    return F.filter("grams", lambda g: F.pmod(F.shiftright(g, _GRAM_BITS), F.lit(PARTS)) == part)


def _links(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar: overlaps are counted per part and summed."""
    one = parts.select(F.col("vertex").alias("b"), "part", F.col("n").alias("n_b"), F.col("grams").alias("grams_b"))
    two = parts.select(F.col("vertex").alias("a"), "part", F.col("n").alias("n_a"), F.col("grams").alias("grams_a"))
    partial = pairs.join(one, "b").join(two, ["a", "part"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("common"))
    total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common"))
    return total.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def similar_groups(docs: DataFrame, n: int = N, percent: int = PERCENT, fragment_shingles: int = FRAGMENT_SHINGLES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_key, n_shingles, comp, component_id.

    Rows link when their sets of n-word shingles have at least ``percent`` of
    their union in common; ``comp`` names the component, ``component_id`` is
    its smallest doc_id. A text of fewer words is one shingle; null and empty
    texts have none, link with nothing, and have no comp and their own id.
    Null ids never name a component unless all its ids are null. Repeated rows
    are members like others. Empty input gives no rows.

    Shingles and sets are compared by value: 48 bits and the fragment within
    it, and 64 bits.
    """
    own = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("text_key"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(1, -(-size // (BYTES_PER_SHINGLE * fragment_shingles)))
    cut = own.mapInArrow(lambda it: _cut(it, n, fragments), CUT)
    held = stage(cut.groupBy("fragment").applyInArrow(lambda t: _shared(t, fragments), HELD), "fragments")
    rows = held.where("bucket IS NULL").select("doc_id", "text_key", "vertex", "n")
    shared = held.where("bucket IS NOT NULL").select("bucket", "vertices", "counts", "grams", "dfs").groupBy("bucket").applyInArrow(_sets, SETS)
    sizes = rows.where("n > 0").groupBy("vertex").agg(F.max("n").alias("n"))

    least = F.ceil(F.col("n") * percent / 100)
    able = shared.join(sizes, "vertex").where(F.size("grams") >= least)
    able = stage(able, "able-documents")
    of_part = [_of_part(k) for k in range(PARTS)]
    parts = stage(able.select("vertex", "n", F.posexplode(F.array(*of_part)).alias("part", "grams")), "parts")

    # the n-grams that are alone come first in the order of frequency, so they take up the prefix
    alone = F.col("n") - F.size("grams")
    ordered = F.slice(F.array_sort(F.arrays_zip("dfs", "grams")), F.lit(1), (F.size("grams") - least + 1).cast("int"))
    prefix = able.select("vertex", "n", alone.alias("alone"), F.posexplode(ordered).alias("k", "g")).select("vertex", "n", "alone", (F.col("alone") + F.col("k")).alias("place"), F.col("g.grams").alias("gram"))
    prefix = stage(prefix, "prefixes")

    pairs = None
    for turn in (["alone", "n", "vertex"], [F.xxhash64("vertex"), "vertex"]):
        hub = F.min(F.struct(*turn, F.struct("vertex", "n", "place").alias("own"))).alias("hub")
        hubs = prefix.groupBy("gram").agg(hub, F.count(F.lit(1)).alias("members")).where("members > 1").select("gram", F.col("hub.own.vertex").alias("a"), F.col("hub.own.n").alias("other_n"), F.col("hub.own.place").alias("other_place"))
        met = prefix.join(hubs, "gram").where((F.col("vertex") != F.col("a")) & _can_link(percent)).select("a", F.col("vertex").alias("b"))
        pairs = met if pairs is None else pairs.unionByName(met)
    edges = stage(_links(pairs.distinct(), parts, percent), "links")
    comps = components(edges)

    # what a group still holds of other components meets the whole group
    placed = stage(prefix.join(comps, "vertex", "left").select("gram", "vertex", "n", "place", F.coalesce("comp", "vertex").alias("comp")), "placed")
    sizes = placed.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("members"))
    major = sizes.groupBy("gram").agg(F.max(F.struct("members", "comp")).alias("most"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("gram", F.col("most.comp").alias("major"))
    open_ = stage(placed.join(major, "gram"), "open-groups")
    minor = open_.where("comp <> major").select("gram", F.col("vertex").alias("other"), F.col("n").alias("other_n"), F.col("place").alias("other_place"), F.col("comp").alias("other_comp"))
    met = open_.join(minor, "gram").where((F.col("comp") != F.col("other_comp")) & _can_link(percent))
    pairs = met.select(F.least("vertex", "other").alias("a"), F.greatest("vertex", "other").alias("b")).distinct()
    rest = stage(_links(pairs, parts, percent), "links")
    comps = components(edges.unionByName(rest)) if not rest.isEmpty() else comps

    members = stage(rows.join(comps, "vertex", "left").select("doc_id", "text_key", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("comp", "vertex").alias("comp")), "members")
    names = members.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return members.join(names, "comp", "left").select("doc_id", "text_key", "n_shingles", "comp", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group, that with the smallest doc_id; all columns as they were.

    Null ids come after all others; rows that tie in id go by a digest of the
    text, and of equal rows one stays. Null, empty and wordless texts are in no
    group: every such row stays, repeated ones too. Empty input gives no rows.
    """
    groups = stage(similar_groups(docs, n, percent), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    kept = groups.where("comp IS NOT NULL").groupBy("comp").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("id"), F.col("k.text_key").alias("key"), F.lit(True).alias("one"))
    kept = kept.unionByName(groups.where("comp IS NULL").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), F.lit(False).alias("one"))).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_key"))
    chosen = packed.join(kept, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_key") == F.col("key")))
    apart = F.when(F.col("one"), F.lit(0).cast("bigint")).otherwise(F.monotonically_increasing_id())
    return chosen.withColumn("_apart", apart).dropDuplicates(["_id", "_key", "_apart"]).select("_row.*")
