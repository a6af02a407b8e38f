"""Join of texts within a Jaccard distance, by Voronoi regions around pivots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import arrays, common, minhash
from terrafold.operators.linked import connected, sent, tasks_for, written

#: Documents, in expectation, from which the shingles that many texts have are told. What they are decides on speed only.
FIT_DOCS, COMMON_SHARE, COMMON_MOST = 20_000, 0.001, 200_000
#: Pivots of a region, members up to which a region is compared whole, and the share of a region's pairs that its cells, guests
#: included, may have for a division to be worth its while.
PIVOTS, LEAF, WORTH = 8, 512, 0.5
#: Items under which a part does not tell texts apart.
FEW_ITEMS = 2


def common_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of the shingles that a share of COMMON_SHARE of a sample of documents have, COMMON_MOST at most."""
    n = docs.where("doc_id is not null").count()
    if not n:
        return np.zeros(0, np.uint64)
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * min(1, FIT_DOCS / n)))
    least = max(20, COMMON_SHARE * min(n, FIT_DOCS))
    found = minhash.sets(some, size).select(F.explode("items").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    rows = found.orderBy(F.desc("c"), "h").limit(COMMON_MOST).select("h").collect()
    return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))


class Classes:
    """Classes of set sizes, a factor of the square root of two wide, and the parts that sets of a class are dealt into.

    Two linked sets, the smaller of n items, differ in n * (100 - percent) / percent items at most. Dealt by hash into `spare`
    parts more than that, they agree in more than `spare` parts. So where one of them has at most `spare` parts of fewer than FEW_ITEMS
    items, they agree in one that has as many. A set that has more such parts is known by these too.
    """

    def __init__(self, percent: int):
        bounds, most = [1], 1 << 40
        while bounds[-1] < most:
            bounds.append(max(bounds[-1] + 1, int(bounds[-1] * 2**0.5)))
        self.low = np.array(bounds)
        self.apart = (self.low[1:] - 1) * (100 - percent) // percent
        self.spare = 1 + self.apart // 4
        self.parts = self.apart + 1 + self.spare
        self.percent = percent

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1


def _part_keys(h: np.ndarray, rare: np.ndarray, counts: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Keys of parts and their sets; h: items of the sets one behind the other, rare: whether few texts have them."""
    own = classes.of(np.maximum(counts, 1))
    least = classes.of(np.maximum(-(-counts * classes.percent // 100), 1))
    ends = np.cumsum(counts)
    out_key, out_set = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for back in range(int((own - least).max(initial=0)) + 1):
        row = np.flatnonzero((own - back >= least) & (counts > 0))
        cls = own[row] - back
        parts, spare = classes.parts[cls], classes.spare[cls]
        some = classes.apart[cls] > 0  # else linked sets are equal
        row, cls, parts, spare = row[some], cls[some], parts[some], spare[some]
        if not len(row):
            continue
        offset = np.concatenate(([0], np.cumsum(parts)))
        n = counts[row]
        at = np.repeat(ends[row] - n - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        of = np.repeat(np.arange(len(row)), n)
        keep = rare[at]
        at, of = at[keep], of[keep]
        mixed = arrays.mix(h[at] ^ np.uint64(0x6A09E667F3BCC909))
        slot = offset[of] + ((mixed >> np.uint64(33)) % parts[of].astype(np.uint64)).astype(np.int64)
        value = np.zeros(offset[-1], np.uint64)
        np.add.at(value, slot, arrays.mix(mixed))
        size = np.bincount(slot, minlength=offset[-1])
        small = size < FEW_ITEMS
        many = np.add.reduceat(small, offset[:-1]) > spare
        who = np.repeat(np.arange(len(row)), parts)
        use = ~small | many[who]
        index = np.arange(offset[-1]) - offset[who]
        key = arrays.mix(value ^ arrays.mix((cls[who] << 40 | index).astype(np.uint64)) ^ size.astype(np.uint64))
        out_key.append(key[use])
        out_set.append(row[who[use]])
    return np.concatenate(out_key), np.concatenate(out_set)


def _signed(docs: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, digest and keys (array of long) of the set of each row; no digest and no keys for an empty set."""
    classes = Classes(percent)
    schema = common.row_schema(docs, "doc_id", "n_shingles long, digest binary, keys array<long>")

    def run(batches):
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(1)]
            for a, b in arrays.blocks(texts):
                h, d = arrays.shingles(arrays.words_of(texts[a:b]), b - a, size)
                counts = np.bincount(d, minlength=b - a)
                ends = np.cumsum(counts)
                rare = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] != h if len(frequent) else np.ones(len(h), bool)
                key, of = _part_keys(h, rare, counts, classes)
                order = np.argsort(of, kind="stable")
                stops = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=b - a)))).astype(np.int32)
                digest = [minhash._digest(h[e - c : e]) for c, e in zip(counts, ends, strict=True)]
                keys = pa.ListArray.from_arrays(pa.array(stops), pa.array(key[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(counts, pa.int64()), pa.array(digest, pa.binary()), keys], names=schema.names)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("_text")).mapInArrow(run, schema)


def families(reps: DataFrame) -> DataFrame:
    """family, doc_id and near of the sets of reps (doc_id, keys) that agree in a part with another, one through another; near: how many
    other sets it meets in all its parts. All linked sets are of one family, all others outside it are further than the distance."""
    keys = reps.select("doc_id", F.explode("keys").alias("key"))
    met = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    near = written(keys.join(met, "key").groupBy("doc_id", "first").agg(F.sum("n").alias("near")))
    nearest = written(near.where("doc_id <> first").groupBy(F.col("doc_id").alias("b")).agg(F.min("first").alias("a")))
    found = minhash._joined(minhash._trees(nearest), near.select(F.col("doc_id").alias("b"), F.col("first").alias("a")))
    total = near.groupBy("doc_id").agg(F.sum("near").alias("near"))
    return found.select(F.col("id").alias("doc_id"), F.col("component").alias("family")).join(total, "doc_id")


def _shares(p: Column, x: Column, percent: int) -> tuple[Column, Column]:
    """Distance of two sets, and whether they are linked."""
    same = F.size(F.array_intersect(p, x))
    union = F.size(p) + F.size(x) - same
    return 1 - same / union, 100 * same >= percent * union


def _divided(members: DataFrame, percent: int, n: int) -> tuple[DataFrame, DataFrame]:
    """members of too large regions (region, doc_id, near, items, home) dealt to the cells of pivots, or left where they are, with
    worth false, in regions that no pivots divide; and pairs (a, b) that links to pivots connect. n: rows of members at most.

    A member is at home in the cell of its nearest pivot, and a guest in those of other pivots that are no further from it than
    that by twice the distance of a link: if y is linked to it, y's nearest pivot is one of these by the triangle inequality.
    """
    rank = lambda j: F.max(F.struct(F.col("near") if j == 0 else F.xxhash64("doc_id", F.lit(j)), "doc_id", "items"))
    pivots = written(members.groupBy("region").agg(*[rank(j).alias(f"p{j}") for j in range(PIVOTS)]), n)
    small = F.broadcast(pivots) if pivots.count() * PIVOTS <= 1000 else pivots
    each = members.join(small, "region")
    cells = [F.struct(*(c.alias(n) for c, n in zip(_shares(F.col(f"p{j}.items"), F.col("items"), percent), ("d", "linked"), strict=True)), F.col(f"p{j}.doc_id").alias("pivot")) for j in range(PIVOTS)]
    placed = each.select("region", "doc_id", "near", "items", "home", F.array_distinct(F.array(*cells)).alias("cells"))
    placed = written(placed.withColumn("own", F.array_min(F.transform("cells", lambda c: F.struct(c["d"], c["pivot"])))))
    near = placed.withColumn("linked", F.transform(F.filter("cells", lambda c: c["linked"]), lambda c: c["pivot"])).where(F.size("linked") > 0).withColumn("low", F.array_min("linked"))
    # a member's link to the first pivot that it has, and what it connects that pivot with, once for all members that do
    ties = near.select(F.col("low").alias("a"), F.explode("linked").alias("b")).where("a <> b").distinct()
    links = near.select(F.col("doc_id").alias("a"), F.col("low").alias("b")).unionByName(ties)
    reach = 2 * (100 - percent) / 100 + 1e-9
    guests = F.filter("cells", lambda c: c["d"] <= F.col("own.d") + reach)
    dealt = placed.select("region", "doc_id", "near", "items", "home", "own", F.explode(F.transform(guests, lambda c: c["pivot"])).alias("cell"))
    sizes = dealt.groupBy("region", "cell").agg(F.count("*").alias("n"), F.sum((F.col("home") & (F.col("cell") == F.col("own.pivot"))).cast("int")).alias("homes"))
    worth = written(sizes.groupBy("region").agg(F.sum(F.col("n") * F.col("homes")).alias("pairs")).join(members.groupBy("region").agg(F.count("*").alias("of")), "region").select("region", (F.col("pairs") <= WORTH * F.col("of") * F.col("of")).alias("worth")), n)
    judged = dealt.select("*", (F.col("cell") == F.col("own.pivot")).alias("at_home")).join(sent(worth), "region")
    region = F.when(F.col("worth"), F.xxhash64("region", "cell")).otherwise(F.col("region"))
    live = judged.where("worth or at_home").select(region.alias("region"), "doc_id", "near", "items", (F.col("home") & F.col("at_home")).alias("home"), "worth")
    return written(live), links


def metric_components(found: DataFrame, pick: minhash.Pick, percent: int) -> DataFrame:
    """id and component (the smallest id) of the sets of found (family, doc_id, near, n_shingles) that have links.

    A family is a region. Regions of more than LEAF members are divided by pivots, again and again; a region that its pivots
    do not divide, since all its members are about as far from each of them, is compared in blocks, as small ones are.
    """
    sets = pick(written(found.select("doc_id")))
    live = written(found.select("doc_id", F.col("family").alias("region"), "near").join(sets, "doc_id").withColumn("home", F.lit(True)))
    leaves, links = [], []
    while True:
        n = live.count()
        sizes = written(live.groupBy("region").agg(F.count("*").alias("n"), F.max("home").alias("some")).where("some and n > 1"), n)
        if sizes.where(f"n > {LEAF}").isEmpty():
            leaves.append(live.join(sent(sizes), "region", "left_semi").select("region", "doc_id"))
            break
        sized = written(live.join(sent(sizes), "region"))
        dealt, linked = _divided(sized.where(f"n > {LEAF}"), percent, n)
        leaves += [sized.where(f"n <= {LEAF}").select("region", "doc_id"), dealt.where("not worth").select("region", "doc_id")]
        live = dealt.where("worth").drop("worth")
        links.append(linked)
    placed = leaves[0]
    for more in leaves[1:]:
        placed = placed.unionByName(more)
    placed = written(placed)
    near = found.select("doc_id", "near", "n_shingles")
    members = placed.withColumnRenamed("region", "family").join(near, "doc_id")
    first = links[0] if links else found.sparkSession.createDataFrame([], minhash.LINKS)
    for more in links[1:]:
        first = first.unionByName(more)
    # what is linked to the same pivot is connected already, and is not compared again
    label = written(first.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("component")))
    members = members.join(sent(label), "doc_id", "left") if links else members.withColumn("component", F.lit(None).cast("long"))
    members = written(members.withColumn("component", F.coalesce("component", "doc_id")))
    n = members.count()
    last = minhash.between(members.coalesce(tasks_for(n)), pick, percent) if n else found.sparkSession.createDataFrame([], minhash.LINKS)
    return connected(last.unionByName(first))


def near_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs (doc_id, text), by the exact join of all texts whose sets of distinct
    `size`-word shingles have 100 * intersection >= percent * union; percent: 75 to 99.

    component_id is the smallest doc_id reachable by links. Texts with fewer words have the whole sequence as their one shingle;
    empty and null texts have an empty set and are linked with nothing. Rows of equal sets are one text from the start. Rows of a
    null doc_id have a null component_id and link no others. Where rows of one doc_id hold different sets, the one of
    the smallest digest stands for them all, except for empty ones. No rows give no rows; other columns are ignored. Shingles
    are compared by 64-bit hashes.

    Unrelated texts are all at distance 1 of each other and of any pivot, where the triangle inequality tells nothing. So the
    space is first cut at that distance: texts of one family agree in a part of their rare shingles (see Classes), others can't
    be linked. Within families, pivots divide (see metric_components).
    """
    signed, pick = minhash.settled(docs, _signed(docs, size, percent, common_shingles(docs.select("doc_id", "text"), size)), size)
    reps = minhash.sets_of(signed, "keys")
    found = written(families(reps).join(reps.select("doc_id", "n_shingles"), "doc_id"))
    if found.isEmpty():
        labels = docs.sparkSession.createDataFrame([], "id long, component long")
    else:
        labels = metric_components(found, pick, percent)
    return minhash.labelled(signed, reps, labels).drop("kept")


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(common.documents(spark, sf_dir), size=3, percent=90)
