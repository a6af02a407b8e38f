"""MinHash near-duplicates with tensored banding and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import arrays, common
from terrafold.operators.linked import FEW, connected, rooted, tasks_for

#: Halves in each of the two collections, and minhashes in a half. A table is keyed by a half of either collection, so
#: HALVES**2 tables of 2 * DEPTH minhashes take 2 * HALVES * DEPTH minhashes to compute. Two texts of similarity s share
#: no table with a chance of 1 - (1 - (1 - s**DEPTH)**HALVES)**2: 6.6e-6 at 0.8, under 1e-9 from 0.88 on.
HALVES, DEPTH = 24, 4


def _halves(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """uint32 values (texts x 2 * HALVES) of the shingle hashes h, whose texts begin at starts."""
    low = (h >> np.uint64(32)).astype(np.uint32)
    odd = (arrays.stream(7, 2 * HALVES * DEPTH) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    out = np.empty((len(starts), 2 * HALVES), np.uint32)
    for half in range(2 * HALVES):
        acc = np.full(len(starts), half, np.uint64)
        for f in odd[half * DEPTH : (half + 1) * DEPTH]:
            acc = arrays.mix(acc * np.uint64(arrays.BASE) + np.minimum.reduceat(low * f, starts))
        out[:, half] = acc >> np.uint64(32)
    return out


def _digest(h: np.ndarray) -> bytes | None:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None


def signatures(docs: DataFrame, size: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, digest of the shingle set and halves (array of int) of each row, repeated rows and null keys included; no
    digest and no halves for an empty set."""
    schema = common.row_schema(docs, key, "n_shingles long, digest binary, halves array<int>")

    def run(batches):
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(1)]
            for a, b in arrays.blocks(texts):
                h, d = arrays.shingles(arrays.words_of(texts[a:b]), b - a, size)
                counts = np.bincount(d, minlength=b - a)
                ends = np.cumsum(counts)
                have = np.flatnonzero(counts)
                rows = iter(_halves(h, (ends - counts)[have]).view(np.int32)) if len(have) else iter(())
                digest = [_digest(h[e - c : e]) for c, e in zip(counts, ends, strict=True)]
                halves = [next(rows) if c else None for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(counts, pa.int64()), pa.array(digest, pa.binary()), pa.array(halves, pa.list_(pa.int32()))], names=schema.names
                )

    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text")).mapInArrow(run, schema)


def sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, the sorted 64-bit hashes of the shingle set, and their digest, of each row of docs (doc_id, text)."""

    def run(batches):
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(1)]
            for a, b in arrays.blocks(texts):
                h, d = arrays.shingles(arrays.words_of(texts[a:b]), b - a, size)
                stops = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=b - a)))).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(h.view(np.int64)))
                digest = [_digest(h[x:y]) for x, y in zip(stops[:-1], stops[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], items, pa.array(digest, pa.binary())], names=["doc_id", "items", "digest"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("_text")).mapInArrow(run, "doc_id long, items array<long>, digest binary")


def _sent(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """rows (of a checkpoint) as the small side of a join: to all tasks if they, or the sum of their weights, are FEW or fewer,
    else left to the planner."""
    size = rows.count() if weight is None else rows.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(rows) if size <= FEW else rows


Pick = Callable[[DataFrame], DataFrame]  # the sets (doc_id, items) of the ids (doc_id)


def _verified(pairs: DataFrame, pick: Pick, percent: int) -> DataFrame:
    """pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    pairs = pairs.coalesce(tasks_for(pairs.count()))
    wanted = common.checkpoint(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    found = pick(wanted)
    left = pairs.join(found.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
    both = left.join(found.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a")
    same = F.size(F.array_intersect("x", "y"))
    counted = both.select("a", "b", same.alias("n"), (F.size("x") + F.size("y")).alias("total"))
    return common.checkpoint(counted.where(100 * F.col("n") >= percent * (F.col("total") - F.col("n"))).select("a", "b").distinct())


def _collections(halves: DataFrame, *columns: str) -> DataFrame:
    """The halves (doc_id, columns, half, value, near) of each text by collection, as arrays first and second, and the sum of
    near."""
    pair = F.struct("half", "value")
    lists = {name: F.collect_list(F.when(on, pair)).alias(name) for name, on in (("first", F.col("half") < HALVES), ("second", F.col("half") >= HALVES))}
    return halves.groupBy("doc_id", *columns).agg(*lists.values(), F.sum("near").alias("near")).where((F.size("first") > 0) & (F.size("second") > 0))


def _shared_halves(reps: DataFrame) -> DataFrame:
    """The collections of each row of reps (doc_id, n_shingles, halves) without halves that a single text has: no table
    keyed by such a half can hold two texts. near counts how often other texts have a half of this one."""
    halves = reps.select("doc_id", "n_shingles", F.posexplode("halves").alias("half", "value"))
    shared = halves.groupBy("half", "value").agg(F.count("*").alias("near")).where("near > 1")
    return _collections(halves.join(shared, ["half", "value"]), "n_shingles")


def _tables(lists: DataFrame, *columns: str) -> DataFrame:
    """key, doc_id and columns for each table of each text: a table is keyed by a half of either collection."""
    firsts = lists.select("doc_id", *columns, F.explode("first").alias("f"), "second")
    return firsts.select("doc_id", *columns, F.explode("second").alias("s"), "f").select(F.xxhash64("f", "s").alias("key"), "doc_id", *columns)


def _stars(lists: DataFrame, fits) -> DataFrame:
    """A pair (a, b) for each text b that is not the centre of all its buckets.

    A bucket's centre is its text that most texts are near, the smallest id of equals; of the centres of b's buckets that
    fit its size, a is again the one that most are near. So the texts made from one meet at it, or at one next to it.
    """
    tables = _tables(lists, "n_shingles", "near")
    rank = F.struct("near", (-F.col("doc_id")).alias("_d"), "n_shingles")
    met = tables.groupBy("key").agg(F.max(rank).alias("c"), F.count("*").alias("_n")).where("_n > 1").select("key", "c")
    pairs = tables.join(met, "key").where((-F.col("c._d") != F.col("doc_id")) & fits(F.col("c.n_shingles"), F.col("n_shingles")))
    return pairs.groupBy(F.col("doc_id").alias("b")).agg((-F.max("c")["_d"]).alias("a")).select("a", "b")


def _trees(links: DataFrame) -> DataFrame:
    """id and component (the smallest id) of every id in links (a, b), where each b has one link, to an a of a higher rank."""
    up = rooted(links.select(F.col("b").alias("id"), F.col("a").alias("root")))
    least = common.checkpoint(up.groupBy("root").agg(F.least(F.col("root"), F.min("id")).alias("component")).coalesce(tasks_for(up.count())))
    members = up.join(_sent(least), "root").select("id", "component")
    return common.checkpoint(members.unionByName(least.select(F.col("root").alias("id"), "component")))


#: Members of a block at most; two blocks at a time are compared in one task. A smaller family is cut into as many as PARTS, of
#: LEAST members or more, so that its comparisons are dealt out too.
BLOCK, PARTS, LEAST = 2048, 24, 128
LINKS = "a long, b long"


def _forest(pairs: list[list[int]]) -> list[int]:
    """Which of pairs connect what those before them do not."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = []
    for k, (x, y) in enumerate(pairs):
        x, y = root(x), root(y)
        if x != y:
            up[x] = y
            out.append(k)
    return out


def _compare(percent: int):
    """Links between components among the members of two blocks, as many as connect all those that are linked.

    Sets come as their differences from the set of the family's pivot, which keeps the distance of any two: x and y differ
    in dx + dy - 2 * (items that both differences have). The `rest` are compared with all, a pair of the rest once.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, comp, n, rest = (table.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "component", "n_shingles", "probe"))
        column = table.column("diff").combine_chunks()
        d = np.diff(column.offsets.to_numpy()).astype(np.int64)
        row = np.repeat(np.arange(len(ids)), d)
        _, item, count = np.unique(column.flatten().to_numpy(), return_inverse=True, return_counts=True)
        dense = np.cumsum(count > 1) - 1  # an item that one member has adds to no intersection
        keep = (count > 1)[item]
        row, item = row[keep], dense[item[keep]]
        order = np.argsort(item, kind="stable")
        row, item = row[order], item[order]
        left, right = np.flatnonzero(rest), np.flatnonzero(~rest)
        common = np.zeros((len(left), len(right)), np.float32)
        width = 2048
        for start in range(0, int(item[-1]) + 1 if len(item) else 0, width):
            x, y = np.searchsorted(item, (start, start + width))
            has = np.zeros((len(ids), width), np.float32)
            has[row[x:y], item[x:y] - start] = 1
            common += has[left] @ has[right].T
        total = n[left][:, None] + n[right][None]
        apart = d[left][:, None] + d[right][None] - 2 * common.astype(np.int64)
        # (total - apart) / 2 is the intersection, (total + apart) / 2 the union
        p, q = np.nonzero((100 * (total - apart) >= percent * (total + apart)) & (comp[left][:, None] != comp[right][None]))
        p, q = left[p], right[q]
        pairs = np.stack((np.minimum(comp[p], comp[q]), np.maximum(comp[p], comp[q])), axis=1)
        each, first = np.unique(pairs, axis=0, return_index=True) if len(pairs) else (pairs, np.zeros(0, np.int64))
        first = first[np.array(_forest(each.tolist()), np.int64)]
        return pa.table({"a": pa.array(np.minimum(ids[p], ids[q])[first]), "b": pa.array(np.maximum(ids[p], ids[q])[first])})

    return run


def _across(lists: DataFrame, labels: DataFrame, pick: Pick, percent: int) -> DataFrame:
    """Links between texts of different components that share a table, which connect all components that are linked.

    Halves and tables that only one component has are left out. Texts that then still share tables, one through another,
    form a family. Its members outside its largest component, the rest, are compared with all members, in blocks, and tasks
    give links only. What goes to the blocks are differences from the family's pivot, the member that most texts are near:
    a few items each, where the members are edited copies. Rows grow with the rest times the blocks of members and with
    the members times the blocks of the rest, never with the pairs.
    """
    component = labels.select(F.col("id").alias("doc_id"), "component")
    named = common.checkpoint(lists.join(_sent(component), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    halves = named.select("doc_id", "near", "component", F.explode(F.concat("first", "second")).alias("h")).select("doc_id", "near", "component", "h.half", "h.value")
    shared = halves.groupBy("half", "value").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select("half", "value")
    mixed = halves.join(shared, ["half", "value"], "left_semi")
    tables = _tables(_collections(mixed, "component"), "component", "near")
    tables = tables.withColumn("rank", F.struct("near", (-F.col("doc_id")).alias("d")))
    met = tables.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.max("rank").alias("centre")).where("_lo < _hi").select("key", "centre")
    meets = tables.join(met, "key").where("centre.d <> -doc_id").groupBy(F.col("doc_id").alias("b"), (-F.col("centre.d")).alias("a")).agg(F.max("centre").alias("rank"))
    meets = common.checkpoint(meets)
    # a family forms like components do: around the centre of the highest rank first, then by what else its texts share
    nearest = common.checkpoint(meets.groupBy("b").agg((-F.max("rank")["d"]).alias("a")))
    family = _joined(_trees(nearest), meets.select("a", "b")).select(F.col("id").alias("doc_id"), F.col("component").alias("family"))
    found = common.checkpoint(named.select("doc_id", "n_shingles", "near", "component").join(_sent(family), "doc_id"))
    members = found.count()
    if not members:
        return lists.sparkSession.createDataFrame([], LINKS)
    found = found.coalesce(tasks_for(members))
    return between(found, pick, percent)


def between(found: DataFrame, pick: Pick, percent: int) -> DataFrame:
    """Links between texts of different components within a family, which connect all that are linked.

    found: family, doc_id, component, n_shingles and near, a row for each member. Members outside the largest component of
    their family are compared with all, in blocks of differences from its pivot, the member of largest near.
    """
    members = found.count()
    parts = common.checkpoint(found.groupBy("family", "component").agg(F.count("*").alias("n"), F.max(F.struct("near", (-F.col("doc_id")).alias("_d"))).alias("_p")).coalesce(tasks_for(members)))
    whole = parts.groupBy("family").agg(
        F.max(F.struct("n", (-F.col("component")).alias("_c"))).alias("_main"), F.sum("n").alias("_all"), F.max("_p").alias("_p"),
    )
    block = F.greatest(F.lit(min(LEAST, BLOCK)), F.least(F.lit(BLOCK), F.ceil(F.col("_all") / PARTS)))
    blocks = lambda n: F.ceil(n / block).cast("int")
    whole = common.checkpoint(whole.select(
        "family", (-F.col("_main._c")).alias("_main"), (-F.col("_p._d")).alias("_pivot"), blocks(F.col("_all")).alias("_of_all"), blocks(F.col("_all") - F.col("_main.n")).alias("_of_rest"),
    ).coalesce(tasks_for(members)))
    texts = common.checkpoint(pick(found.select("doc_id")).coalesce(tasks_for(members)))
    placed = found.join(_sent(whole), "family").join(texts, "doc_id")
    pivots = common.checkpoint(placed.where("doc_id = _pivot").groupBy("family").agg(F.first("items").alias("_h")))
    pivoted = placed.join(_sent(pivots, F.size("_h")), "family")
    diff = F.concat(F.array_except("items", "_h"), F.array_except("_h", "items"))
    held = common.checkpoint(pivoted.select("family", "doc_id", "component", F.col("n_shingles").cast("long"), "_main", "_of_all", "_of_rest", diff.alias("diff")))
    own = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    row = ("family", "i", "j", "doc_id", "component", "n_shingles", "diff", "probe")
    probes = held.where("component <> _main").withColumns({"i": own(F.col("_of_rest")), "probe": F.lit(True)}).withColumn("j", each(F.col("_of_all"))).select(*row)
    others = held.withColumns({"j": own(F.col("_of_all")), "probe": F.lit(False)}).withColumn("i", each(F.col("_of_rest"))).select(*row)
    return common.checkpoint(probes.unionByName(others).groupBy("family", "i", "j").applyInArrow(_compare(percent), LINKS).distinct())


#: Copies of one text above which its component is sent to all tasks instead of being joined: there are few such texts.
MANY = 10_000


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text).

    Texts are linked whose sets of distinct `size`-word shingles have 100 * intersection >= percent * union; component_id is
    the smallest doc_id reachable. Empty and null texts have an empty set and are linked with nothing. Rows of equal sets
    are one text from the start, whatever their number. Rows of a null doc_id stand alone: component_id null, kept true.
    Where rows of one doc_id hold different sets, the one of the smallest digest stands for them all, except for empty ones.
    No rows give no rows. Shingles are compared by 64-bit hashes: between two texts of n shingles, two unlike ones are taken
    for one with odds of n * n / 2**64.

    Candidates meet in a table bucket. First, every text is verified against one text of its buckets that many are near.
    Where a bucket then still holds several components, its texts are compared in blocks, so no pair that shares a bucket
    stays both untested and apart.
    """
    signed, pick = settled(docs, signatures(docs, size), size)
    reps = sets_of(signed, "halves")
    lists = common.checkpoint(_shared_halves(reps))
    fits = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)  # noqa: E731  sizes further apart can't be linked
    stars = common.checkpoint(_stars(lists, fits))
    links = _verified(stars, pick, percent)
    labels = _trees(links)
    more = _across(lists, labels, pick, percent)
    if not more.isEmpty():
        labels = _joined(labels, more)
    return labelled(signed, reps, labels)


def sets_of(signed: DataFrame, *columns: str) -> DataFrame:
    """digest, doc_id (the smallest), the largest doc_id, copies, n_shingles and columns of each distinct set that rows stand for."""
    counts = [F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("_last"), F.count("*").alias("copies")]
    return common.checkpoint(signed.where("stands").groupBy("digest").agg(*counts, *[F.first(c).alias(c) for c in ("n_shingles", *columns)]))


def settled(docs: DataFrame, signed: DataFrame, size: int) -> tuple[DataFrame, Pick]:
    """signed (doc_id, n_shingles, digest and more), written, and the sets of any ids. Where rows of one doc_id hold different sets,
    the digest of the smallest replaces theirs; stands: whether the row has a doc_id and the set that it goes by."""
    signed = common.checkpoint(signed.withColumn("doc_id", F.col("doc_id").cast("long")))
    several = common.checkpoint(signed.where("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("_d"), F.max("digest").alias("_e")).where("_d <> _e").select("doc_id", "_d"))
    at_odds = not several.isEmpty()
    if at_odds:
        signed = signed.join(_sent(several), "doc_id", "left").withColumn("own", F.col("digest")).withColumn("digest", F.when(F.col("own").isNotNull(), F.coalesce("_d", "own"))).drop("_d")

    def pick(ids: DataFrame) -> DataFrame:
        found = sets(common.with_ids(docs.select("doc_id", "text"), ids, FEW), size)
        if at_odds:
            found = found.join(_sent(several), "doc_id", "left").where("_d is null or _d = digest")
        return found.select("doc_id", "items")

    stands = F.col("digest").isNotNull() & F.col("doc_id").isNotNull() & (F.col("own") == F.col("digest") if at_odds else F.lit(True))
    return signed.withColumn("stands", F.coalesce(stands, F.lit(False))), pick


def labelled(signed: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of the rows of signed, given the components of the ids of reps (of sets_of)."""
    # rows whose text has copies or links: others are their own component
    named = reps.select("digest", "doc_id", "_last", "copies").join(_sent(labels.withColumnRenamed("id", "doc_id")), "doc_id", "left")
    named = common.checkpoint(named.where("component is not null or _last > doc_id").select("digest", "copies", F.coalesce("component", "doc_id").alias("_c")))
    rows = signed.select("doc_id", "n_shingles", "digest")
    if named.count() <= FEW:
        out = rows.join(F.broadcast(named.drop("copies")), "digest", "left")
    else:
        many = named.where(F.col("copies") >= MANY).select("digest", F.col("_c").alias("_m"))
        out = rows.join(F.broadcast(many), "digest", "left")
        lone = out.where("_m is not null or digest is null").select("doc_id", "n_shingles", F.col("_m").alias("_c"))
        rest = out.where("_m is null and digest is not null").drop("_m").join(named.where(F.col("copies") < MANY).drop("copies"), "digest", "left")
        out = lone.unionByName(rest.select("doc_id", "n_shingles", "_c"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels after further links between ids: only components that the links name go through rounds again."""
    ends = lambda df, k: df.join(_sent(labels.select(F.col("id").alias(k), F.col("component").alias(f"_{k}"))), k, "left")
    between = ends(ends(more, "a"), "b").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b")
    between = common.checkpoint(between.distinct())
    n = between.count()
    if not n:
        return labels
    merged = connected(between.coalesce(tasks_for(n)))
    moved = labels.join(_sent(merged.select(F.col("id").alias("component"), F.col("component").alias("_to"))), "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
    fresh = merged.join(labels.select("id"), "id", "left_anti")
    return common.checkpoint(moved.unionByName(fresh))


def dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near copies: of each component one row, of its smallest doc_id.

    Of rows of one doc_id the one that sorts first by a digest of all its columns stays; only such rows are shuffled whole.
    Rows of a null doc_id all stay, as do rows without words but for repeats of their doc_id. Columns stay as they are.
    """
    found = near_duplicates(docs.select("doc_id", "text"), size, percent)
    gone = common.checkpoint(found.where("not kept").select("doc_id").distinct())
    return common.one_each(common.without_ids(docs, gone, FEW))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir), size=2, percent=80)
