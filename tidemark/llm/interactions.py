"""Filter interaction audit: what each filter removes in every order of application, by Lehmer-rank difference arrays.

A document is reduced to the mask of filters that it fails. Whatever the order, it is removed by the first letter of
its mask; the orders that begin with letters outside the mask and then have a certain letter of it are consecutive in
the lexicographic order of permutations, whose ranks are Lehmer codes in the factorial number system. So a mask takes
up intervals of ranks for each step. The count of a mask is added where its intervals begin and taken off where they
end, and a prefix sum over the ranks gives what each order removes at each step. The rest follows from that.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import read, slices

LETTERS = "ABCDE"
#: Fixed values of the filters: least words, least percentage of distinct words, most percentage of capitals, symbols.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, b"#$%&*|"
_CAPITALS = bytes(range(65, 91))
_CONTINUING = bytes(range(128, 192))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text whose words are told apart at a time.
BLOCK_BYTES = 8 << 20


def word_counts(raw: bytes) -> tuple[int, int]:
    """(words, distinct words) of UTF-8 text; a long text is cut at white space into blocks, and words are kept once."""
    if len(raw) <= BLOCK_BYTES:
        words = raw.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + BLOCK_BYTES)
        end = cut.start() if cut else len(raw)
        words = raw[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def content_mask(raw: bytes) -> int:
    """Bits of the filters A to D that a text fails, bit 0 for A."""
    words, distinct = word_counts(raw)
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    points = len(raw.translate(None, _CONTINUING))
    symbols = len(raw) > len(raw.translate(None, SYMBOLS))
    return (words < LEAST_WORDS) | (100 * distinct < LEAST_DISTINCT * words) << 1 | (100 * capitals > MOST_CAPITALS * points) << 2 | symbols << 3


def document_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) of each row: the lang, '' for null; SHA-256 of the text; filters A to D that it fails.

    Null text is empty text: it has no words and fails A alone. Repeated rows are repeated; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("mask", pa.int32())])

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(2).fill_null("").cast(pa.binary()).to_pylist()
            found = [hashlib.sha256(t).digest() for t in texts], [content_mask(t) for t in texts]
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(x, f.type) for x, f in zip(found, list(schema)[2:]))], schema=schema)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each mask of all five filters, and how many have quality 1 and toxic 1.

    E fails where a row of smaller doc_id has the same text; rows without a doc_id are neither smaller nor larger than
    any other. A doc_id is good (toxic) if any row of labels says so; labels without documents don't count.

    Copies of a text share all else of their mask, so the table is folded before texts meet: rows of one text,
    part and label become their number, their least doc_id and the rows that have it. A text with any number of
    copies is then four rows a part at most.
    """
    rows = document_masks(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    flags = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    flags = flags.agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    # Rows without a doc_id find no label; the salt spreads them over the tasks of the join.
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))
    rows = rows.join(flags.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left").na.fill(0, ["good", "toxic"])
    texts = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("at_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    first = F.coalesce(F.col("least") == F.min("least").over(Window.partitionBy("digest")), F.lit(False))
    texts = texts.withColumn("pass", F.col("unnamed") + F.when(first, F.col("at_least")).otherwise(0))
    e = 1 << LETTERS.index("E")
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("pass").alias("n")), F.struct((F.col("mask") + e).alias("mask"), (F.col("n") - F.col("pass")).alias("n"))))
    both = texts.select("part", "good", "toxic", split.alias("x")).select("part", "good", "toxic", "x.*")
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def lehmer_rank(prefix: tuple[int, ...], letters: int) -> int:
    """The rank of the first permutation of range(letters), in lexicographic order, that begins with prefix."""
    return sum(factorial(letters - 1 - i) * (x - sum(y < x for y in prefix[:i])) for i, x in enumerate(prefix))


def intervals(mask: int, letters: int) -> list[tuple[int, int, int]]:
    """(step, begin, end): the ranks of the orders in which a document of this mask is removed at a step; none for mask 0."""
    held = [x for x in range(letters) if mask >> x & 1]
    free = [x for x in range(letters) if not mask >> x & 1]
    out = []
    for step in range(1, len(free) + 2 if held else 0):
        found: list[list[int]] = []
        for begin in sorted(lehmer_rank((*before, x), letters) for before in permutations(free, step - 1) for x in held):
            if found and found[-1][1] == begin:
                found[-1][1] += factorial(letters - step)
            else:
                found.append([begin, begin + factorial(letters - step)])
        out += [(step, *x) for x in found]
    return out


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, mask, n, good, toxic) -> one row for each part, order of the letters and step, zeros included.

    Bit k of a mask is the letter k. Every part of counts gets all rows, also with a mask 0 only; an empty table none.
    All tables made here have sizes that the number of letters bounds, times the parts.
    """
    spark, k = counts.sparkSession, len(letters)
    orders = list(permutations(range(k)))
    ends = [(m, step, at, sign) for m in range(1 << k) for step, begin, end in intervals(m, k) for at, sign in ((begin, 1), (end, -1)) if at < len(orders)]
    ends = spark.createDataFrame(ends, "mask int, step int, lehmer int, sign int")
    places = [(rank, step + 1, "".join(letters[x] for x in order), letters[order[step]]) for rank, order in enumerate(orders) for step in range(k)]
    places = spark.createDataFrame(places, "lehmer int, step int, filter_order string, letter string")

    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)) for i in range(k)]
    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(k)]
    by_letter = lambda sums: F.create_map(*(x for a, s in zip(letters, sums) for x in (F.lit(a), s)))
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), by_letter(fails).alias("fails"), by_letter(alone).alias("alone"))
    changes = counts.join(F.broadcast(ends), "mask").groupBy("part", "step", "lehmer").agg(*(F.sum(F.col(c) * F.col("sign")).alias(c) for c in ("n", "good", "toxic")))

    grid = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("lehmer")).join(F.broadcast(places), "lehmer")
    filled = grid.join(changes, ["part", "step", "lehmer"], "left").na.fill(0, ["n", "good", "toxic"])
    prefix = Window.partitionBy("part", "step").orderBy("lehmer").rowsBetween(Window.unboundedPreceding, 0)
    filled = filled.select("part", "filter_order", "lehmer", "step", "letter", *(F.sum(c).over(prefix).alias(a) for c, a in (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))))
    gone = F.sum("removed").over(Window.partitionBy("part", "lehmer").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    filled = filled.withColumn("gone", gone).withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).join(parts, "part")
    return filled.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.col("gone")).alias("kept"),
        "removed",
        (F.element_at("fails", F.col("letter")) - F.col("removed")).alias("redundant"),
        F.element_at("alone", F.col("letter")).alias("unique_fails"),
        "good_lost",
        "toxic_lost",
        "shapley",
    )


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(mask_counts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), counted AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM docs
), flags AS (
  SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(flags.toxic, 0) AS toxic,
    CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN counted.doc_id > least THEN 'E' ELSE '' END AS mask
  FROM counted LEFT JOIN flags ON counted.doc_id = flags.doc_id
), masks AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x
), steps AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders),
cut AS (
  SELECT part, filter_order, step, filter_order[step] AS letter, n, good, toxic,
    contains(mask, filter_order[step]) AS hit, mask = filter_order[step] AS sole,
    len(translate(filter_order[1:step - 1], mask, '')) < step - 1 AS earlier
  FROM masks, steps
), summed AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (WHERE NOT earlier AND NOT hit), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE NOT earlier AND hit), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE earlier AND hit), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE sole), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT earlier AND hit), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE NOT earlier AND hit), 0)::BIGINT AS toxic_lost
  FROM cut GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM summed
"""
