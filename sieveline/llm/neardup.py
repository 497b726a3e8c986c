"""Operator 2: near-duplicate documents by bottom-k sketches and exact verification.

1. One hash function over each document's distinct word shingles; its k smallest values are the sketch. Equal
   sets (by size and 128 bits of their hashes) become one class: copies cost one row, aggregated before the shuffle.
2. Inverted lists of retained values generate pairs. Two sketches of similar sets share at least ``_needed`` values,
   so, with values ordered from rare to frequent, they share one among the first |sketch| - needed + 1 (the prefix
   filter principle): only those are listed, and frequent values drop out of most lists.
3. Within a list every member is first paired with the list's smallest class only. Verified links give components;
   lists whose members are in one component are done. In the others the members outside the list's main component
   are paired with those of other components: row by row in lists of up to ``SMALL`` members; members of longer lists
   are gathered by main component, once whatever number of lists they share, and compared in blocks, which emit no
   pair that is not similar. A large group of near copies so costs its size, and the outsiders of large groups
   blocks of sketch comparisons; no candidate between different components is left out.
4. Pairs pass a size test, then the union-sketch estimate (share of common values among the k smallest of the union;
   exact for sets within k), then exact Jaccard on full sets, recomputed from whole texts. In blocks sketches have
   ``WIDE`` values, so that most sets are whole and confirmed there. Of its links a block gives those that join components,
   fewer than members; where sets are not whole it names the members in doubt, which ``exact_links`` compares in blocks.

Joins on a list's head and on the class of many copies deal frequent keys over several tasks (``common.join_hot``).

Defined results: documents without words or text have empty sets and are linked with nothing; rows with a null id have
no component and are kept. An id is one document: rows that repeat it, with equal or different texts, are linked by it,
and each of them is returned with its own number of shingles; the order of rows changes nothing. Ties do not arise, a
component is named by its smallest id. An empty table gives an empty one; other columns play no part, whatever their
names. Links are missed only if a sketch deviates by more than 4.5 standard deviations (under one in 100,000 at a
similarity of exactly the threshold, far less above); ``k=EXACT`` keeps whole sets as sketches and finds every link.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import mix, shingle_sets

K = 64
WIDE = 512
EXACT = (1 << 31) - 1
SMALL = 48
ROWS, COLUMNS = 128, 512  # members that one block compares
VALUES = 1 << 20  # values of either side that a block of whole sets holds, but for a single larger set
_TOP = np.uint64(1 << 63)


def _signed(x: np.ndarray) -> np.ndarray:
    """Unsigned order kept in signed longs."""
    return (x ^ _TOP).view(np.int64)


def _slack(k: int, percent: int) -> int:
    j = percent / 100
    return math.ceil(4.5 * math.sqrt(k * j * (1 - j)))


def _needed(n: int, k: int, percent: int) -> int:
    """Values that sketches of similar sets share at least, where one set has ``n`` shingles.

    Up to percent * k shingles both sketches are whole sets and the bound is exact; beyond, it leaves 4.5 deviations.
    """
    if n * 100 <= percent * k:
        return -(-percent * n // 100)
    return min(k, n) * percent // 100 - _slack(k, percent)


def sketches(docs: DataFrame, width: int, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, n, s1, s2, sketch): set size, 128-bit set hash and k smallest shingle hashes of each document."""

    def run(batch: pa.RecordBatch):
        texts = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
        for a, b in common.steps([len(x) for x in texts]):
            sets = shingle_sets(texts[a:b], width)
            n = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
            sums = []
            for x in (mix(flat + np.uint64(1)), mix(flat ^ np.uint64(0xD6E8FEB86659FD93))):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
                at = np.concatenate(([0], np.cumsum(n)))
                sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
            low = [_signed(s[:k]) for s in sets]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in low]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), pa.array(sums[0]), pa.array(sums[1]),
                 pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*low, np.zeros(0, np.int64)])))],
                ["doc_id", "version", "n", "s1", "s2", "sketch"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.version(F.col(text_col)).alias("version"), F.col(text_col).alias("text"))
    return common.map_batches(rows, run, "doc_id long, version long, n long, s1 long, s2 long, sketch array<long>")


def postings(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(value, class, n): the rarest values of each sketch that its prefix holds; values of a single class are never listed."""
    exploded = classes.select("class", "n", F.explode("sketch").alias("value"))
    frequent = exploded.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = exploded.join(frequent, "value")
    whole = F.col("n") * 100 <= percent * k
    needed = F.when(whole, F.ceil(F.col("n") * percent / 100)).otherwise(F.floor(F.least("n", F.lit(k)) * percent / 100) - _slack(k, percent))
    # values that no other class has are the rarest of all: they fill the prefix first
    room = F.least("n", F.lit(k)) - needed + 1 - (F.least("n", F.lit(k)) - F.size("values"))
    grouped = shared.groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"))
    listed = grouped.withColumn("room", room.cast("int")).where("room > 0")
    return listed.select("class", "n", F.explode(F.slice("values", F.lit(1), F.col("room"))).alias("v")).select(F.col("v.value").alias("value"), "class", "n")


def _similar_sizes(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def likely(pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose union-sketch estimate does not rule them out."""
    left = classes.select(F.col("class").alias("a"), F.col("sketch").alias("ska"), F.col("n").alias("na"))
    right = classes.select(F.col("class").alias("b"), F.col("sketch").alias("skb"), F.col("n").alias("nb"))
    both = common.join_hot(pairs, left, ["a"], ["b"]).join(right, "b")
    common_values = F.array_intersect("ska", "skb")
    union = F.slice(F.array_sort(F.array_union("ska", "skb")), 1, k)
    hits = F.size(F.array_intersect(union, common_values))
    exact = (F.col("na") <= k) & (F.col("nb") <= k)
    whole = F.size(common_values) * 100 >= percent * (F.col("na") + F.col("nb") - F.size(common_values))
    return both.where(F.when(exact, whole).otherwise((hits + _slack(k, percent)) * 100 >= percent * F.size(union))).select("a", "b")


def texts_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(class, text) of the ``wanted`` classes: the text of each one's representative row, once if that row is repeated."""
    few = classes.select("class", "doc_id", "version").join(wanted, "class", "left_semi")
    return docs.join(few, ["doc_id", "version"]).select("class", "text").dropDuplicates(["class"])


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` (a written table) with that exact Jaccard similarity over the shingles of their whole texts.

    A class's text is fetched once; the text of a head that many pairs share is shuffled once for each of its parts.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    texts = common.materialize(texts_of(wanted, classes, docs), "near-texts")
    joined = (
        common.join_hot(pairs, texts.select(F.col("class").alias("a"), F.col("text").alias("ta")), ["a"], ["b"])
        .join(texts.select(F.col("class").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
    )

    def run(batch: pa.RecordBatch):
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ta, tb = batch.column(2), batch.column(3)
        sets: dict[int, np.ndarray] = {}
        keep = []
        for i in range(len(a)):
            own = []
            for key, column in ((a[i], ta), (b[i], tb)):
                if key not in sets:
                    if len(sets) > 64:
                        sets.clear()
                    sets[key] = shingle_sets([(column[i].as_py() or "").encode()], width)[0]
                own.append(sets[key])
            x, y = own
            same = len(np.intersect1d(x, y, assume_unique=True))
            if same and 100 * same >= percent * (len(x) + len(y) - same):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    return common.map_batches(joined, run, "a long, b long")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, k: int, percent: int) -> DataFrame:
    """The similar ones among ``pairs`` (a written table)."""
    return confirm(common.materialize(likely(pairs, classes, k, percent), "near-likely"), classes, docs, width, percent)


def _counts(table: pa.Table, r: np.ndarray, c: np.ndarray, column: str) -> np.ndarray:
    """Common values of the lists of rows ``r`` and rows ``c``, all by all."""
    lists = table[column].combine_chunks()
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)

    def entries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = offsets[rows + 1] - offsets[rows]
        at = np.repeat(offsets[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return values[at], np.repeat(np.arange(len(rows)), size)

    vr, ir = entries(r)
    vc, ic = entries(c)
    shared = np.intersect1d(vr, vc)
    counts = np.zeros((len(r), len(c)), np.float32)
    for i in range(0, len(shared), 2048):
        part = shared[i : i + 2048]
        grids = []
        for v, rows, total in ((vr, ir, len(r)), (vc, ic, len(c))):
            at = np.minimum(np.searchsorted(part, v), len(part) - 1)
            there = part[at] == v
            grid = np.zeros((total, len(part)), np.float32)
            grid[rows[there], at[there]] = 1
            grids.append(grid)
        counts += grids[0] @ grids[1].T
    return counts


def _joining(ok: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs ``ok`` (row, column) as many as join the components ``left`` and ``right``, and where components are apart after that."""
    uniq, at = np.unique(np.concatenate((left, right)), return_inverse=True)
    rows, columns, label = at[: len(left)], at[len(left) :], np.arange(len(uniq))
    out: list[tuple[int, int]] = []
    for i in range(len(left)):
        found = np.flatnonzero(ok[i])
        mine = label[rows[i]]
        met, first = np.unique(label[columns[found]], return_index=True)
        out += [(i, j) for j in found[first[met != mine]].tolist()]
        label[np.isin(label, met)] = mine
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1], label[rows][:, None] != label[columns][None, :]


def _block_links(table: pa.Table, percent: int, k: int) -> pa.Table:
    """(main, a, b): similar pairs of one block that join components, sure since both sets are whole.

    Where sets are not, a member of side 0 that may be similar to one of side 1 is there as (a, null), that one as (null, b).
    """
    side = table["side"].to_numpy()
    ids, parts, n = (table[c].to_numpy() for c in ("id", "component", "n"))
    main = table["main"].to_numpy()
    lists = table["sketch"].combine_chunks()
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    r, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    a, b = pa.array([], pa.int64()), pa.array([], pa.int64())
    if len(r) and len(c):
        counts = _counts(table, r, c, "sketch")
        nr, nc = n[r][:, None], n[c][None, :]
        whole = (nr <= k) & (nc <= k)
        # of a truncated sketch only values up to the smaller of both last ones are comparable
        last = np.where(n > k, values[np.maximum(offsets[1:] - 1, 0)], np.iinfo(np.int64).max)
        limit = np.minimum(last[r][:, None], last[c][None, :])
        size_r, size_c = np.minimum(n[r], k)[:, None] + 0 * limit, np.minimum(n[c], k)[None, :] + 0 * limit
        for i in np.flatnonzero((~whole).any(axis=1)):
            size_r[i] = np.searchsorted(values[offsets[r[i]] : offsets[r[i] + 1]], limit[i], side="right")
        for j in np.flatnonzero((~whole).any(axis=0)):
            size_c[:, j] = np.searchsorted(values[offsets[c[j]] : offsets[c[j] + 1]], limit[:, j], side="right")
        union = size_r + size_c - counts
        share = percent / 100
        slack = 4.5 * np.sqrt(union * share * (1 - share)) * ~whole
        ok = (counts > 0) & ((counts + slack) * 100 >= percent * union)
        ok &= (nr * 100 >= nc * percent) & (nc * 100 >= nr * percent)
        ok &= parts[r][:, None] != parts[c][None, :]
        # two outsiders meet twice: from the smaller id only
        ok &= (parts[c] == main[c])[None, :] | (ids[r][:, None] < ids[c][None, :])
        i, j, apart = _joining(ok & whole, parts[r], parts[c])
        doubt = ok & ~whole & apart
        x, y = ids[r[doubt.any(axis=1)]], ids[c[doubt.any(axis=0)]]
        a = pa.concat_arrays([pa.array(ids[r[i]]), pa.array(x), pa.nulls(len(y), pa.int64())])
        b = pa.concat_arrays([pa.array(ids[c[j]]), pa.nulls(len(x), pa.int64()), pa.array(y)])
    return pa.table({"main": pa.array(np.full(len(a), main[0])), "a": a, "b": b})


def _exact_links(table: pa.Table, percent: int) -> pa.Table:
    """Similar pairs of one block that join components, by what their sets differ in from a common third."""
    side, ids, n, parts = (table[c].to_numpy() for c in ("side", "id", "n", "component"))
    size = np.diff(table["diff"].combine_chunks().offsets.to_numpy())
    r, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    i = j = r[:0]
    if len(r) and len(c):
        apart = size[r][:, None] + size[c][None, :] - 2 * _counts(table, r, c, "diff").astype(np.int64)
        total = n[r][:, None] + n[c][None, :]
        same = (total - apart) // 2
        i, j, _ = _joining((same > 0) & (100 * same >= percent * (total - same)), parts[r], parts[c])
    return pa.table({"a": ids[r[i]], "b": ids[c[j]]})


def exact_links(suspects: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of exactly similar pairs that join components, between both sides of ``suspects`` (main, component, id, side; a written table).

    Sets travel as their symmetric differences from one member's set, which tell the sizes of all intersections:
    |x xor y| = |dx| + |dy| - 2 |dx and dy|. Near copies differ little, and a block gives fewer pairs than it has members.
    """
    key, both = ["main"], suspects
    refs = both.where("side = 1").groupBy(*key).agg(F.min("id").alias("ref"))
    named = common.materialize(common.join_hot(both, refs, key, ["id"]), "near-refs")
    texts = common.materialize(texts_of(both.select(F.col("id").alias("class")).distinct(), classes, docs), "near-texts")
    joined = (
        common.join_hot(named, texts.select(F.col("class").alias("ref"), F.col("text").alias("tr")), ["ref"], ["id"])
        .join(texts.select(F.col("class").alias("id"), "text"), "id").select("main", "component", "side", "id", "ref", "text", "tr")
    )

    def run(batch: pa.RecordBatch):
        refs, texts, other = batch.column(4).to_pylist(), batch.column(5), batch.column(6)
        known: dict[int, np.ndarray] = {}
        for a, b in common.steps([len(x) for x in texts.cast(pa.binary()).to_pylist()]):
            n, diffs = [], []
            for i in range(a, b):
                if refs[i] not in known:
                    if len(known) > 16:
                        known.clear()
                    known[refs[i]] = shingle_sets([other[i].as_py().encode()], width)[0]
                own = shingle_sets([texts[i].as_py().encode()], width)[0]
                n.append(len(own))
                diffs.append(np.setxor1d(own, known[refs[i]], assume_unique=True).view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in diffs]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(diffs)))
            yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(a, b - a) for j in range(4)), pa.array(n, pa.int64()), lists], ["main", "component", "side", "id", "n", "diff"])

    diffs = common.materialize(common.map_batches(joined, run, "main long, component long, side int, id long, n long, diff array<long>"), "near-diffs")
    blocks = lambda own, most: F.greatest(F.lit(1), F.ceil(F.sum(own) / most), F.ceil(F.sum(own * F.size("diff")) / VALUES))
    outer = (F.col("side") == 0).cast("long")
    sizes = diffs.groupBy(*key).agg(blocks(outer, ROWS).alias("rows"), blocks(1 - outer, COLUMNS).alias("columns"))
    placed = common.join_hot(diffs, sizes, key, ["id", "side"])
    # a suspect goes to one row of blocks and every column, a member to one column and every row
    count = F.when(F.col("side") == 0, F.col("columns")).otherwise(F.col("rows"))
    own = F.pmod(F.xxhash64("id", "side"), F.when(F.col("side") == 0, F.col("rows")).otherwise(F.col("columns")))
    dealt = placed.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).alias("each"))
    block = F.concat_ws(" ", *key, F.when(F.col("side") == 0, F.concat_ws(" ", "own", "each")).otherwise(F.concat_ws(" ", "each", "own")))
    # one column names the block: dealt by the main component alone, all its blocks would be one task's
    rows = dealt.select(block.alias("block"), "component", "side", "id", "n", "diff")
    common.ship_package(docs.sparkSession)
    return rows.groupBy("block").applyInArrow(lambda t: _exact_links(t, percent), "a long, b long")


def block_links(members: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, wide: int = WIDE) -> DataFrame:
    """(main, a, b) of ``_block_links`` among ``members`` (main, id, component): blocks of bounded size."""
    needed = texts_of(members.select(F.col("id").alias("class")), classes, docs)
    wider = common.materialize(sketches(needed, width, wide, "class").select(F.col("doc_id").alias("id"), "n", "sketch"), "near-wide")
    outside = F.col("component") != F.col("main")
    sizes = members.groupBy("main").agg(F.ceil(F.sum(outside.cast("long")) / ROWS).alias("rows"), F.ceil(F.count("*") / COLUMNS).alias("columns"))
    placed = members.join(sizes, "main")
    row, column = F.pmod(F.xxhash64("id"), F.col("rows")), F.pmod(F.xxhash64("id", F.lit(1)), F.col("columns"))
    both = (
        placed.where(outside).select("*", row.alias("rb"), F.explode(F.sequence(F.lit(0), F.col("columns").cast("long") - 1)).alias("cb"), F.lit(0).alias("side"))
        .unionByName(placed.select("*", column.alias("cb"), F.explode(F.sequence(F.lit(0), F.col("rows").cast("long") - 1)).alias("rb"), F.lit(1).alias("side")))
    )
    rows = both.select("main", "rb", "cb", "side", "id", "component").join(wider, "id")
    common.ship_package(docs.sparkSession)
    return rows.groupBy("main", "rb", "cb").applyInArrow(lambda t: _block_links(t, percent, wide), "main long, a long, b long")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, k: int = K, id_col: str = "doc_id", text_col: str = "text", by_id: bool = True
) -> DataFrame:
    """One row a document: (doc_id, n_shingles, component_id, kept, version); ``version`` tells the texts of one id apart.

    Without ``by_id`` rows are not linked by a common id, only by what they hold.
    """
    with common.scratch() as keep:
        table, named = _components(docs, width, percent, k, id_col, text_col, by_id)
        keep(table)
        keep(named)
    return (
        common.join_hot(table.select("doc_id", "version", "n", "s1", "s2"), named, ["n", "s1", "s2"], ["doc_id", "version"], "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).cast("long").alias("component_id"), "version",
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        .select("doc_id", "n_shingles", "component_id", "kept", "version")
    )


def _components(docs: DataFrame, width: int, percent: int, k: int, id_col: str, text_col: str, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """The written tables of sketches, and of component names by class (n, s1, s2, component_id)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("version", common.version(F.col("text")))
    table = common.materialize(sketches(docs, width, k), "near-sketches")
    # classes get numbers of their own, since an id can have several; the numbers are fixed once they are written
    representative = F.min(F.struct("doc_id", "version")).alias("r")
    classes = table.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(representative, F.any_value("sketch").alias("sketch"))
    classes = common.materialize(classes.select(F.monotonically_increasing_id().alias("class"), "n", "s1", "s2", "r.doc_id", "r.version", "sketch"), "near-classes")
    lists = common.materialize(postings(classes, k, percent), "near-lists")

    heads = lists.groupBy("value").agg(F.min(F.struct("class", "n")).alias("head"))
    stars = (
        lists.join(heads, "value").select(F.col("head.class").alias("a"), F.col("head.n").alias("na"), F.col("class").alias("b"), F.col("n").alias("nb"))
        .where("a < b").where(_similar_sizes("na", "nb", percent)).select("a", "b").distinct()
    )
    stars = common.materialize(stars, "near-stars")
    first = common.materialize(verify(stars, classes, docs, width, k, percent), "near-links")
    groups = common.connected_components(first)
    placed = common.materialize(
        lists.join(groups.withColumnRenamed("id", "class"), "class", "left").select("value", "class", "n", F.coalesce("component", "class").alias("component")),
        "near-placed",
    )
    counted = placed.groupBy("value", "component").agg(F.count("*").alias("m"))
    # of equally large components the smallest class, so that lists with the same members agree
    mixed = counted.groupBy("value").agg(
        F.max_by("component", F.struct("m", -F.col("component"))).alias("main"), F.count("*").alias("parts"), F.sum("m").alias("total")
    ).where("parts > 1").select("value", "main", "total")
    apart = placed.join(mixed, "value")
    short = apart.where(F.col("total") <= SMALL)
    few = short.where("component <> main").select("value", F.col("class").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"))
    # pairs of two outsiders are met once, from the smaller class
    pairs = (
        few.join(short.select("value", F.col("class").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"), "main"), "value")
        .where("cx <> cy and (cy = main or x < y)").where(_similar_sizes("nx", "ny", percent))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    )
    rest = common.materialize(pairs.join(stars, ["a", "b"], "left_anti"), "near-pairs")
    second = verify(rest, classes, docs, width, k, percent)
    long = apart.where(F.col("total") > SMALL)
    members = common.materialize(long.select("main", F.col("class").alias("id"), "component").distinct(), "near-members")
    blocks = common.materialize(block_links(members, classes, docs, width, percent, max(k, WIDE)), "near-blocks")
    links = first.unionByName(second).unionByName(blocks.where("a is not null and b is not null").select("a", "b"))
    doubt = blocks.where("a is null or b is null").select("main", F.coalesce("a", "b").alias("id"), F.col("b").isNotNull().cast("int").alias("side"))
    suspects = common.materialize(doubt.distinct().join(members, ["main", "id"]), "near-suspects")
    if not suspects.isEmpty():
        links = links.unionByName(exact_links(suspects, classes, docs, width, percent))
    if by_id:
        # an id with several texts links their classes: from the smallest to each
        held = table.where("n > 0 and doc_id is not null").select("doc_id", "n", "s1", "s2")
        differs = F.expr("min(s1) <> max(s1) or min(s2) <> max(s2) or min(n) <> max(n)")
        several = held.groupBy("doc_id").agg(differs.alias("d")).where("d").select("doc_id")
        own = held.join(several, "doc_id").distinct().join(classes.select("n", "s1", "s2", "class"), ["n", "s1", "s2"]).select("doc_id", "class")
        own = common.materialize(own, "near-same-id")
        links = links.unionByName(
            own.join(own.groupBy("doc_id").agg(F.min("class").alias("a")), "doc_id").where("a <> class").select("a", F.col("class").alias("b"))
        )
    final = common.connected_components(common.materialize(links, "near-links"))
    in_component = classes.select("class", "n", "s1", "s2", "doc_id").join(final.withColumnRenamed("id", "class"), "class", "left")
    in_component = common.materialize(in_component.withColumn("component", F.coalesce("component", "class")), "near-component")
    smallest = in_component.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = common.join_hot(in_component, smallest, ["component"], ["class"]).select("n", "s1", "s2", "component_id")
    return table, common.materialize(named, "near-named")


def drop_copies(docs: DataFrame, width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) but those that are linked to a row with a smaller id.

    Each row is judged by its own text: of two texts under one id one can go and the other stay. Columns and their order stay.
    """
    marked = near_duplicates(docs, width, percent, k, by_id=False).where("not kept").select("doc_id", "version").distinct()
    names = docs.columns
    packed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), common.version(F.col("text")).alias("version"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    )
    return packed.join(marked, ["doc_id", "version"], "left_anti").select(*[F.col("row").getField(c).alias(c) for c in names])
