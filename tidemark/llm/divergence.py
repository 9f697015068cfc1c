"""Source divergence audit: term frequencies by language and source, compared by a chi-square-like distance in integers.

One pass of bytes.translate lowers letters and blanks what separates terms, bytes.split and a Counter for each document
give its frequencies; a task folds documents of one language and source before anything is shuffled. What Spark
aggregates is sparse: a row for each term that a group has. Groups are compared in blocks of terms and tiles of
sources, by array operations; terms that neither group of a pair has in a block all add the same, by their number.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, read, sized, slices, stored

#: Documents of a language that a term must be in, the ranks of part `term`.
LEAST_DOCUMENTS, TERM_RANKS = 3, 200
#: The scale of shares: p is one more than the share in units of 1 / SCALE, rounded down.
SCALE = 1_000_000_000
#: Entries of a task's counters before they are passed on; bytes of a text that are split at a time.
HELD, BLOCK_BYTES = 400_000, 4 << 20
#: Sources of a tile, rows of a block of terms, terms compared at a time.
TILE, BLOCK_ROWS, AT_A_TIME = 64, 40_000, 64
#: Lowers A-Z and blanks the bytes that are no part of a term: all of ASCII but letters.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def frequencies(raw: bytes) -> Counter:
    """Occurrences of each term of one text; a long text is split in blocks that end between terms."""
    flat = raw.translate(TABLE)
    if len(flat) <= BLOCK_BYTES:
        return Counter(flat.split())
    found, at = Counter(), 0
    while at < len(flat):
        end = flat.find(b" ", at + BLOCK_BYTES)
        end = len(flat) if end < 0 else end
        found.update(flat[at:end].split())
        at = end
    return found


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) by task: occurrences and documents of each term in a group, to be summed.

    Null lang, source and text are ''. Repeated rows count as documents of their own; other columns are not read.
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])

    def rows(groups):
        for (lang, source), (total, n) in groups.items():
            terms = pa.array(list(total), pa.binary()).cast(pa.string())
            same = lambda x: pa.repeat(pa.scalar(x, pa.string()), len(terms))
            yield pa.record_batch([same(lang), same(source), terms, pa.array(total.values(), pa.int64()), pa.array([n[t] for t in total], pa.int64())], schema=schema)

    def run(batches):
        groups, held = {}, 0
        for batch in slices(batches):
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for lang, source, raw in zip(langs, sources, texts):
                found = frequencies(raw)
                total, n = groups.setdefault((lang, source), (Counter(), Counter()))
                before = len(total)
                total.update(found)
                n.update(found.keys())
                held += len(total) - before
                if held > HELD:
                    yield from rows(groups)
                    groups, held = {}, 0
        yield from rows(groups)

    return _named(docs).mapInArrow(run, "lang string, source string, term string, count long, docs long")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def kept_terms(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, count, lang_count): what each group has of the terms in enough documents of its language."""
    rows = term_counts(docs).repartition("lang", "term")  # all below is by these two
    rows = rows.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")
    rows = rows.select("lang", "source", "term", "count", F.sum("count").over(of).alias("lang_count"), F.sum("docs").over(of).alias("lang_docs"))
    return rows.filter(F.col("lang_docs") >= least_documents).drop("lang_docs")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), in decimals, so that no count is too large."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + F.lit(1)), wide(total) + wide(terms)) + F.lit(1)


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, place, total, terms, lang_total, absent): every group that occurs, with its place among the sources
    of its language, its occurrences of kept terms, those of the language, their number, and the share of a term it lacks."""
    names = _named(docs.select("lang", "source", F.lit("").alias("text"))).select("lang", "source").distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    langs = kept.groupBy("lang", "term").agg(F.first("lang_count").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    found = names.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    return found.withColumn("absent", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(F.lit(1)))


_SUMS = pa.schema([("lang", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("value", pa.int64()), ("seen", pa.int64())])


def tile_sums(table: pa.Table) -> pa.Table:
    """Sums of distances over the terms of one block, for the ordered pairs of sources of one pair of tiles.

    Rows without a term give every source of the tiles and its share of absent terms; others a term's share in a source.
    """
    lang, first, second = (table.column(c)[0].as_py() for c in ("lang", "a", "b"))
    place, p = table.column("place").to_numpy(), table.column("p").to_numpy()
    named = table.column("term").combine_chunks().dictionary_encode()
    lacks = np.asarray(named.is_null())
    sources = np.unique(place[lacks])
    absent = np.empty(len(sources), np.int64)
    absent[np.searchsorted(sources, place[lacks])] = p[lacks]
    shares = np.tile(absent, (len(named.dictionary), 1))
    shares[np.asarray(named.indices.fill_null(0))[~lacks], np.searchsorted(sources, place[~lacks])] = p[~lacks]
    left, right = (np.flatnonzero(sources // TILE == t) for t in (first, second))
    out = []
    for x, y in {(first, second): (left, right), (second, first): (right, left)}.values():
        total = np.zeros((len(x), len(y)), np.int64)
        for at in range(0, len(shares), AT_A_TIME):
            some = shares[at : at + AT_A_TIME]
            q = some[:, None, y]
            total += ((some[:, x, None] - q) ** 2 // q).sum(axis=0)
        i, j = np.nonzero(sources[x][:, None] != sources[y][None, :])
        out.append((sources[x][i], sources[y][j], total[i, j]))
    i, j, value = (np.concatenate(c) for c in zip(*out))
    return pa.table([pa.repeat(pa.scalar(lang, pa.string()), len(i)), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(value), pa.repeat(pa.scalar(len(shares), pa.int64()), len(i))], schema=_SUMS)


def pair_distances(rows: DataFrame, groups: DataFrame, blocks: int) -> DataFrame:
    """(lang, source, item, value): the distance of each group from each other of its language, over all kept terms."""
    terms = rows.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), "place", "term", "p", "tiles")
    tiles = F.ceil((F.max("place").over(Window.partitionBy("lang")) + 1) / TILE)
    groups = groups.withColumn("tiles", tiles)
    lacking = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "place", F.lit(None).cast("string").alias("term"), F.col("absent").alias("p"), "tiles")
    own = F.floor(F.col("place") / TILE)
    rows = terms.unionByName(lacking).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select("lang", F.least(own, "other").alias("a"), F.greatest(own, "other").alias("b"), "block", F.col("place").cast("long").alias("place"), "term", "p")
    sums = rows.groupBy("lang", "a", "b", "block").applyInArrow(tile_sums, "lang string, i long, j long, value long, seen long")
    sums = sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    one = groups.select("lang", F.col("place").cast("long").alias("i"), "source", F.col("absent").alias("p"), "terms")
    other = groups.select("lang", F.col("place").cast("long").alias("j"), F.col("source").alias("item"), F.col("absent").alias("q"))
    sums = sums.join(sized(one), ["lang", "i"]).join(sized(other), ["lang", "j"])
    rest = F.col("value") + (F.col("terms") - F.col("seen")) * distance(F.col("p"), F.col("q"))
    return sums.select("lang", "source", "item", rest.cast("long").alias("value"))


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's distances from the other sources of its language, and the
    terms that it has more of than its language.

    Groups without terms take part; the only source of a language has no pairs; an empty table has no rows. Texts of any
    length are split in blocks. Equal values rank by the item's bytes.
    """
    kept = stored(kept_terms(docs, least_documents))
    groups = stored(groups_of(docs, kept))
    rows = kept.join(sized(groups.withColumn("tiles", F.ceil((F.max("place").over(Window.partitionBy("lang")) + 1) / TILE))), ["lang", "source"])
    rows = rows.withColumn("p", share(F.col("count"), F.col("total"), F.col("terms"))).withColumn("q", share(F.col("lang_count"), F.col("lang_total"), F.col("terms")))
    pairs = pair_distances(rows, groups, 1 + kept.count() // BLOCK_ROWS)
    terms = rows.filter("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    ranked = [(pairs, "pair", None), (terms, "term", term_ranks)]

    def part(df: DataFrame, name: str, most: int | None) -> DataFrame:
        by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        df = df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
        return df if most is None else df.filter(F.col("rank") <= most)

    found = stored(reduce(DataFrame.unionByName, (part(*x) for x in ranked)))
    discard(kept, groups)
    return found


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), occurrences AS (
  SELECT d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM occurrences GROUP BY lang, term HAVING count(DISTINCT d) >= 3
), sizes AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM occurrences SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (t.total + s.v) AS p, 1 + 1000000000 * (k.n + 1) // (s.total + s.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) JOIN totals t USING (lang, source) LEFT JOIN counts c USING (lang, source, term)
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM parts
) WHERE part = 'pair' OR rank <= 200
"""
