"""Near-duplicate documents: an exact set-similarity join of word shingles, with no candidate left to chance.

1. Texts of equal shingle sets are one class.
2. Two sets of a Jaccard similarity of s share one of the first n - ceil(s * n) + 1 of each, in any one order. By the
   order of rarity, shingles of one class alone come first and meet nobody, and so few rows of the prefixes are left.
3. Classes that share such a shingle meet if what follows it still allows the similarity: in a few rounds only with one
   class there and the one before, by another order each, which joins large groups in linear work, then with all of
   other groups.
4. Groups that a caller has found by another method, such as SimHash, meet before that, each class with the least.
5. What met is verified by the whole sets; groups are the connected components of what is similar.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Words, discard, release, rolling, slices, stored
from tidemark.llm.graph import components

#: Similarity as a fraction.
NUM, DEN = 4, 5
#: Bits of a shingle's hash: sets are sorted, so that shorter ones are stored in fewer bytes.
HASH_BITS = 48
#: Rounds that join large groups before all that is left meets.
STARS = 2


def shingle_sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, ts): the distinct 48-bit hashes, sorted, of the lower-cased (A-Z) word shingles; all words where these are fewer."""

    def run(batches):
        for batch in slices(batches):
            words = Words(batch.column(1), lower=True)
            h, sets = words.hashes(), []
            whole = rolling(h, shingle_words)
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                some = whole[a : b - shingle_words + 1] if b - a >= shingle_words else rolling(h[a:b], b - a) if b > a else h[:0]
                sets.append(np.unique(some >> np.uint64(64 - HASH_BITS)))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["doc_id", "ts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ts array<long>")


def _prefix(n: Column) -> Column:
    return n - F.ceil(n * NUM / DEN).cast("int") + 1


def _shared(rows: DataFrame) -> DataFrame:
    """The rows (c, t) whose shingle t other classes have too, with df, the number of these classes."""
    return rows.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("t"))).filter("df > 1")


def _keys(classes: DataFrame) -> DataFrame:
    """(t, c, n, left): a row for each shared prefix shingle of each class, rarest first; left: its shingles from that on."""
    rows = classes.select("c", F.size("ts").alias("n"), F.explode("ts").alias("t"))
    order = Window.partitionBy("c")
    # The shingles that no other class has precede these.
    left = F.count(F.lit(1)).over(order) - F.row_number().over(order.orderBy("df", "t")) + 1
    return stored(_shared(rows).withColumn("left", left.cast("int")).filter(F.col("n") - F.col("left") < _prefix(F.col("n"))).select("t", "c", "n", "left"))


def _may(a: str, b: str) -> Column:
    """Whether this shingle may be the first in common of similar sets a and b, by what follows it."""
    return F.least(F.col(f"{a}.left"), F.col(f"{b}.left")) * (NUM + DEN) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * NUM


def _stars(named: DataFrame, seed: int) -> DataFrame:
    """(a, b): the classes of each shingle with its first class and the one before, by an order of this seed."""
    row, order = F.struct("c", "n", "left", "root"), Window.partitionBy("t").orderBy(F.xxhash64("c", F.lit(seed)), "c")
    near = named.select(row.alias("a"), F.first(row).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("p"), F.lag(row, 1).over(order).alias("q"))
    return near.select("a", F.explode(F.array("p", "q")).alias("b")).filter("b.root <> a.root").filter(_may("a", "b"))


def _all(named: DataFrame) -> DataFrame:
    """(a, b): all classes of a shingle and different groups."""
    a, b = named.alias("a"), named.alias("b")
    return a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("b.c") < F.col("a.c")) & (F.col("a.root") != F.col("b.root")) & _may("a", "b"))


def _verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): the pairs whose sets are similar."""
    pairs = stored(pairs.distinct())
    asked = pairs.select(F.col("u").alias("c")).unionByName(pairs.select(F.col("v").alias("c"))).distinct()
    met = stored(classes.join(asked, "c", "left_semi"), deltas=True)  # so that all sets are shuffled once and not for each side
    release(pairs.sparkSession)
    one = met.select(F.col("c").alias("u"), "ts").join(pairs, "u")
    two = met.select(F.col("c").alias("v"), F.col("ts").alias("ts2")).join(pairs, "v")
    similar = F.size(F.array_intersect("ts", "ts2")) * (NUM + DEN) >= (F.size("ts") + F.size("ts2")) * NUM
    found = stored(one.join(two, ["u", "v"]).filter(similar).select("u", "v"))
    discard(met, pairs)
    return found


def _of_groups(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """(u, v): the class of each row with the least class of its group."""
    groups = groups.filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("group"))  # a row for each doc_id, however often it repeats
    found = sets.join(groups, "doc_id").select("c", "group").distinct()
    least = found.groupBy("group").agg(F.min("c").alias("v"), F.max("c").alias("most")).filter("v < most")
    return found.join(least, "group").filter("c > v").select(F.col("c").alias("u"), "v")


def similar_documents(docs: DataFrame, shingle_words: int = 5, groups: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id): component_id is the least doc_id reachable over texts of a shingle similarity of 0.8 or more.

    groups (doc_id, component_id) are taken first, verified, so that only what they miss is left to the join. Null and empty texts have no shingles and are alike; a null doc_id takes part but is never the least. Other
    columns are not read.
    """
    spark = docs.sparkSession
    made = shingle_sets(docs, shingle_words).withColumn("c", F.xxhash64("ts"))
    sets = stored(made.select("doc_id", "c"))
    classes = stored(made.groupBy("c").agg(F.first("ts").alias("ts")), deltas=True)  # made again, as both copies of the sets would fill the disks
    release(spark)
    keys = _keys(classes)
    release(spark)
    links = _verified(_of_groups(sets, groups), classes) if groups is not None else classes.limit(0).select(F.col("c").alias("u"), F.col("c").alias("v"))
    release(spark)
    for k in range(STARS + 1):
        # What is left are shingles of several groups.
        named = keys.join(components(links), F.col("c") == F.col("node"), "left").select("t", "c", "n", "left", F.coalesce("root", "c").alias("root"))
        mixed = named.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("t")
        named = stored(named.join(mixed, "t", "left_semi"))
        pairs = _stars(named, k) if k < STARS else _all(named)
        found = _verified(pairs.select(F.greatest("a.c", "b.c").alias("u"), F.least("a.c", "b.c").alias("v")), classes)
        links = links.unionByName(found)
        release(spark)
    roots = components(links)
    found = sets.select("doc_id", "c").join(roots, F.col("c") == F.col("node"), "left").select("doc_id", F.coalesce("root", "c").alias("root"))
    discard(keys, classes)
    least = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "root").select("doc_id", "component_id")
