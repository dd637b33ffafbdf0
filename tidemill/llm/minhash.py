"""Near-duplicate grouping by SuperMinHash signatures.

1. One pass over the texts makes, for each document, the fingerprint of its
   shingle set and the keys of its signature's bands. SuperMinHash gives every
   element one permutation of the registers: in round j an element offers the
   value ``j + uniform`` to the j-th register of its permutation. Values of a
   later round never beat those of an earlier one, so a document stops as soon
   as all its registers are filled, mostly after one or two rounds.
2. Equal sets collapse to one node (a map-side minimum, so a huge group of
   copies is no hot spot).
3. Nodes that share a band meet. Those of a bucket are compared, on their full sets,
   with one centre, the least node. What is then still apart is
   found from the differences to the centre, which near copies keep short: let M
   be the set that the members of a centre agree on by majority, D(x) the
   symmetric difference of x and M, and u(x) = |D(x)| - |x| * (1-s)/(1+s). Two
   members x and y are linked if and only if ``2 * |D(x) & D(y)| >= u(x) + u(y)``.
   So each member with ``u(x) + min u <= 0`` is linked with the member that has the
   least u. What is tied together by now has one label and need not meet. Any other
   link has ends of two labels, which share some differences: such pairs meet by the
   rarest of these (a prefix filter; what one label alone has cannot be shared, and the
   least u among the other labels' members that have a difference tells how many must
   be). A difference that many share names a family, a part of its group, which gets a
   centre of its own and another round; differences to that follow from those to M. A
   family lacks its centre and is smaller than its group, so the rounds end. No bucket
   emits all its pairs, yet no linked pair that shares a band is lost, unless its ends
   are tied together otherwise.
4. Links are grouped after each round, and once at the end, by distributed union-find (``graph.components``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import Scratch, byte_column, chunks, distinct_sets, map_batches, mix, shingles, word_hashes
from tidemill.llm.graph import components


#: Ids that may be broadcast (16 bytes of key and 8 of id each).
SMALL_IDS = 200_000
#: Pairs of the members that share a difference, up to which they are compared
#: pair by pair; beyond that they are a family with a centre.
SMALL_GROUP = 1024


@dataclass(frozen=True)
class NearDupRules:
    """Shingle width in words, similarity in hundredths, bands and their rows.

    At similarity 0.85 a pair misses all 16 bands of 4 with a chance of about
    7e-6, at 0.8 with about 3e-4 (then use more bands)."""

    width: int = 3
    percent: int = 85
    bands: int = 16
    rows: int = 4


_GOLD = 0x9E3779B97F4A7C15


def _draw(x: np.ndarray, step: int) -> np.ndarray:
    return mix(x + np.uint64(_GOLD * (step + 1) % (1 << 64)))


def super_minhash(starts: np.ndarray, values: np.ndarray, m: int) -> np.ndarray:
    """Signatures (texts x m, float64) of the sets ``values[starts[i]:starts[i+1]]``.

    Equal registers of two sets mean that the same element won there. An empty
    set keeps infinite registers."""
    n = len(starts) - 1
    out = np.full(n * m, np.inf)
    size = np.diff(starts)
    owner = np.repeat(np.arange(n), size)
    live, perm = values, None
    for j in range(m):
        uniform = (_draw(live, 2 * j) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        pick = j + (_draw(live, 2 * j + 1) % np.uint64(m - j)).astype(np.int64)
        if perm is None:
            register = pick
        else:
            row = np.arange(len(live))
            register = perm[row, pick].astype(np.int64)
            perm[row, pick] = perm[row, j]
            perm[row, j] = register
        np.minimum.at(out, owner * m + register, uniform + j)
        open_text = np.isinf(out.reshape(n, m)).any(axis=1) & (size > 0)
        if not open_text.any():
            break
        keep = open_text[owner]
        if perm is None:
            owner, live, pick = owner[keep], live[keep], pick[keep]
            perm = np.tile(np.arange(m, dtype=np.uint16 if m > 255 else np.uint8), (len(live), 1))
            row = np.arange(len(live))
            perm[row, pick] = 0
            perm[row, 0] = pick
        elif not keep.all():
            owner, live, perm = owner[keep], live[keep], perm[keep]
    return out.reshape(n, m)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Texts x bands of int64 keys; the band's number is part of the hash."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), bits.shape[:2]).copy()
    for k in range(rows):
        key = mix(key ^ bits[:, :, k]) + np.uint64(_GOLD)
    return mix(key).view(np.int64)


def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    doc, word, _, _ = word_hashes(data, offsets)
    owner, hashed = shingles(doc, word, width)
    return distinct_sets(owner, hashed, len(offsets) - 1)


def _fingerprints(starts: np.ndarray, values: np.ndarray) -> list[bytes | None]:
    """16 bytes for each set, None for an empty one."""
    size = np.diff(starts)
    full = np.flatnonzero(size)
    parts = np.zeros((len(full), 2), np.uint64)
    if len(full):
        at = starts[:-1][full]
        parts[:, 0] = mix(np.add.reduceat(mix(values ^ np.uint64(0x6A09E667F3BCC908)), at) + size[full].astype(np.uint64))
        parts[:, 1] = mix(np.add.reduceat(mix(values + np.uint64(0xBB67AE8584CAA73B)), at))
    out: list[bytes | None] = [None] * len(size)
    for i, row in zip(full.tolist(), parts):
        out[i] = row.tobytes()
    return out


def signatures(docs: DataFrame, rules: NearDupRules) -> DataFrame:
    """``(doc_id, n_shingles, node, bands)`` of each row of ``docs(doc_id, text)``;
    node and bands are null where there is no word."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            starts, values = _sets(*byte_column(batch.column(1)), rules.width)
            nodes = _fingerprints(starts, values)
            keys = band_keys(super_minhash(starts, values, rules.bands * rules.rows), rules.bands, rules.rows)
            empty = np.diff(starts) == 0
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), rules.bands).cast(pa.list_(pa.int64()))
            lists = pa.array([None if e else x for e, x in zip(empty, lists.to_pylist())], pa.list_(pa.int64())) if empty.any() else lists
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(starts)), pa.array(nodes, pa.binary()), lists], names=schema.names)

    return map_batches(docs.select("doc_id", "text"), sign, schema)


def _sets_of(wanted: DataFrame, docs: DataFrame, rules: NearDupRules) -> DataFrame:
    """``(node, size, delta)``: the full sets of ``wanted(node, doc_id)``, made anew
    from the whole texts. Up to SMALL_IDS ids, counted first, are broadcast (24 bytes
    each), so that only the texts asked for leave their scan; beyond that the join
    shuffles."""
    few = wanted.count() <= SMALL_IDS
    texts = docs.join(F.broadcast(wanted) if few else wanted, "doc_id").select("node", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            starts, values = _sets(*byte_column(batch.column(1)), rules.width)
            # Another text under the same doc_id has another fingerprint.
            own = pa.array([x is not None and x == y for x, y in zip(_fingerprints(starts, values), batch.column(0).to_pylist())], pa.bool_())
            sets = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(starts)), sets], names=["node", "size", "delta"]).filter(own)

    return map_batches(texts, make, "node binary, size long, delta array<long>").dropDuplicates(["node"])


def _compared(pairs: DataFrame, sets: DataFrame, by: list[str], rules: NearDupRules) -> DataFrame:
    """``pairs(*by, a, b)`` with a's ``size``, whether they are ``linked``, and
    ``delta``, the elements that only one of them has. ``sets(*by, node, size,
    delta)`` holds sets, or their differences to a set that all of ``by`` share:
    the result is the same. A centre b may be hot; both sides of its join are
    scanned or shuffled as they are, so Spark can split it."""
    mine = sets.select(*by, F.col("node").alias("a"), "size", F.col("delta").alias("mine"))
    theirs = sets.select(*by, F.col("node").alias("b"), F.col("size").alias("other"), F.col("delta").alias("theirs"))
    joined = pairs.join(mine, [*by, "a"]).join(theirs, [*by, "b"])
    delta = F.concat(F.array_except("mine", "theirs"), F.array_except("theirs", "mine"))
    linked = F.lit(100 + rules.percent) * F.size("delta") <= F.lit(100 - rules.percent) * (F.col("size") + F.col("other"))
    return joined.withColumn("delta", delta).withColumn("linked", linked).drop("mine", "theirs", "other")


def _relabelled(rows: DataFrame, edges: DataFrame, keep: Scratch, *columns: str) -> DataFrame:
    """``rows`` with the labels in ``columns`` replaced by the least of those that
    ``edges(a, b)`` of labels tie together."""
    if edges.isEmpty():
        return rows
    tied = keep.saved(components(edges, keep), "tied")
    for column in columns:
        new = tied.select(F.col("node").alias(column), F.col("label").alias("tied"))
        rows = rows.join(new, column, "left").withColumn(column, F.coalesce("tied", column)).drop("tied")
    return rows


def _divided(members: DataFrame, keep: Scratch) -> DataFrame:
    """``(g, n)`` of the groups that hold two labels."""
    groups = members.groupBy("g").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most"))
    return keep.saved(groups.filter("n > 1 and least != most").select("g", "n"), "groups")


def _apart(members: DataFrame, rules: NearDupRules, keep: Scratch) -> tuple[DataFrame, DataFrame | None] | None:
    """Links between the labels of groups ``members(g, node, label, size, delta)``, and the
    members of the families that are left for another round; None if no group holds two
    labels. A label names what is linked already; delta is the difference to the centre of g."""
    groups = _divided(members, keep)
    if groups.isEmpty():
        return None
    members = members.join(groups, "g", "left_semi")
    # What one member alone has is no majority's (n > 1).
    often = members.select("g", F.explode("delta").alias("e")).groupBy("g", "e").agg(F.count("*").alias("often")).filter("often > 1")
    agreed = keep.saved(often.join(groups, "g").filter("2 * often > n").groupBy("g").agg(F.collect_list("e").alias("agreed")), "agreed")
    # From here on delta is the difference to the majority's set, and u is scaled to whole numbers.
    up, down = 100 + rules.percent, 100 - rules.percent
    common = F.coalesce("agreed", F.array().cast("array<long>"))
    delta = F.concat(F.array_except("delta", common), F.array_except(common, "delta"))
    scored = members.join(agreed, "g", "left").withColumn("delta", delta).withColumn("u", F.lit(up) * F.size("delta") - F.lit(down) * F.col("size"))
    scored = keep.saved(scored.select("g", "node", "label", "size", "u", "delta"), "scored")
    best = keep.saved(scored.groupBy("g").agg(F.min(F.struct("u", "node", "label")).alias("best")), "best")
    known = scored.join(best, "g").withColumn("best", F.col("best.label"))
    core = known.join(best.select("g", F.col("best.u").alias("least")), "g").filter("u + least <= 0 and label != best")
    core = keep.saved(core.select(F.col("label").alias("a"), F.col("best").alias("b")).distinct(), "core")
    # What the best member ties together need not meet; often that is the whole group.
    known = keep.saved(_relabelled(known, core, keep, "label", "best").withColumn("top", F.expr("label = best")).drop("best"), "known")
    known = known.join(_divided(known, keep), "g", "left_semi")

    # Only differences that two labels share can link them. A partner of the top label's members has
    # another label, so what must be shared follows from the least u among the others that hold e.
    each = ["g", "node", "label", "size", "u", "top", F.size("delta").alias("many"), F.explode("delta").alias("e")]
    lows = [F.min(F.when(F.col("top") == x, F.col("u"))).alias(name) for x, name in ((True, "low"), (False, "rest"))]
    labels = [F.min("label").alias("least"), F.max("label").alias("most")]
    held = known.select(*each).groupBy("g", "e").agg(F.count("*").alias("share"), *lows, *labels).filter("least != most")
    held = keep.saved(held.select("g", "e", "share", "low", "rest"), "held")
    most = F.when(F.col("top"), F.col("rest")).otherwise(F.least("low", "rest"))
    rows = known.select(*each).join(held, ["g", "e"]).filter(F.lit(2 * up) * F.col("many") >= F.col("u") + most)
    # At the rarest difference that two linked members share, the others are more frequent; and
    # only ``spare`` of a member's may be left unshared.
    spare = F.floor(F.col("size") * F.lit(down * (100 + rules.percent)) / F.lit(up * rules.percent))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("g", "node").orderBy(F.desc("share"), "e")))
    rows = rows.filter((F.lit(2 * up) * F.col("place") >= F.col("u") + most) & (F.col("place") >= F.col("many") - spare))
    told = keep.saved(rows.select("g", "e", "node", "label", "size", "u", "top", "place"), "told")
    meet = told.groupBy("g", "e").agg(F.count("*").alias("n"), F.count_if(~F.col("top")).alias("others"), *lows, *labels, F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("first"))
    meet = keep.saved(meet.filter("least != most").select("g", "e", "low", "rest", (F.col("n") * F.col("others") <= SMALL_GROUP).alias("small"), F.col("first.node").alias("centre")), "meet")
    if meet.isEmpty():
        return core, None
    enough = F.lit(2 * up) * F.col("place") >= F.col("u") + most
    told = keep.saved(told.join(meet, ["g", "e"]).filter(enough).drop("low", "rest"), "enough")
    left = told.filter("small and not top").select("g", "e", F.col("node").alias("x"), F.col("label").alias("lx"), F.col("size").alias("mine"), F.col("u").alias("ux"), F.col("place").alias("px"))
    right = told.filter("small").select("g", "e", F.col("node").alias("y"), F.col("label").alias("ly"), "size", "u", "place", "top")
    alike = F.lit(100) * F.least("mine", "size") >= F.lit(rules.percent) * F.greatest("mine", "size")
    enough = F.lit(2 * up) * F.least("px", "place") >= F.col("ux") + F.col("u")
    met = left.join(right, ["g", "e"]).filter("lx != ly and (top or x < y)").filter(alike & enough)
    met = met.select("g", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(False).alias("open"))
    star = told.filter("not small and node != centre").select("g", F.col("node").alias("a"), F.col("centre").alias("b"), F.lit(True).alias("open"))
    pairs = keep.saved(met.union(star).groupBy("g", "a", "b").agg(F.bool_or("open").alias("open")), "pairs")
    tested = _compared(pairs, known.select("g", "node", "size", "delta"), ["g"], rules).withColumn("delta", F.when(F.col("open"), F.col("delta")))
    for end, name in (("a", "label"), ("b", "other")):
        tested = tested.join(known.select("g", F.col("node").alias(end), F.col("label").alias(name)), ["g", end])
    tested = keep.saved(tested, "tested")
    links = keep.saved(tested.filter("linked and label != other").select(F.col("label").alias("a"), F.col("other").alias("b")).distinct(), "links")
    further = tested.filter("open").select(F.unhex(F.md5(F.concat("g", "b"))).alias("g"), F.col("a").alias("node"), "label", "size", "delta")
    return core.union(links), keep.saved(_relabelled(further, links, keep, "label"), "members")


def near_duplicates(docs: DataFrame, rules: NearDupRules | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    component_id is the smallest doc_id that links lead to. A null, empty or
    blank text has no shingle and is linked with nothing, nor is a row whose
    doc_id is null (component_id null, kept true). Repeated rows give repeated
    rows. Texts of any length count whole; ties cannot arise, since the smallest
    doc_id decides. An empty table gives an empty result; other columns are not read."""
    rules = rules or NearDupRules()
    docs = docs.select("doc_id", "text")
    keep = Scratch(docs.sparkSession)
    signed = keep.saved(signatures(docs, rules), "signed", merge=False)
    known = signed.filter("doc_id is not null and node is not null")
    nodes = keep.saved(known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "nodes")

    rows = nodes.select("node", F.explode("bands").alias("key"))
    buckets = keep.saved(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("centre")).filter("n > 1").select("key", "centre"), "buckets")
    star = rows.join(buckets, "key").filter("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    pairs = keep.saved(star.distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = keep.saved(wanted.join(nodes.select("node", "doc_id"), "node"), "wanted")
    sets = keep.saved(_sets_of(wanted, docs, rules), "sets")
    tested = keep.saved(_compared(pairs, sets, [], rules), "tested")
    # What is linked already need not meet again.
    label = keep.saved(components(tested.filter("linked").select("a", "b"), keep), "label")
    label = label.select(F.col("node").alias("a"), "label")
    members = tested.join(label, "a", "left").select(F.col("b").alias("g"), F.col("a").alias("node"), F.coalesce("label", "a").alias("label"), "size", "delta")
    links, members = [label.toDF("a", "b")], keep.saved(members, "members")
    while members is not None and (found := _apart(members, rules, keep)):
        links.append(found[0])
        members = found[1]

    named = components(reduce(DataFrame.union, links), keep)
    root = nodes.select("node", "doc_id").join(named, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = root.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    least = keep.saved(least, "least")
    named_nodes = keep.saved(root.join(least, "label").select("node", "component_id"), "components")
    keep.drop(but=("signed", "components"))
    return (
        signed.select("doc_id", "n_shingles", "node")
        .join(named_nodes, "node", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_duplicates(docs: DataFrame, rules: NearDupRules | None = None) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id.

    Rows that share a doc_id stay together, as they cannot be told apart by it."""
    gone = near_duplicates(docs, rules).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
