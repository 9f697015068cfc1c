"""Line dedup: an exact set-similarity join of lines, in DataFrame operations only.

1. Words are counted in a sketch of a fixed number of hash buckets; the words of a line are ordered by the level of
   their bucket's count, rarest first, then by hash: one order for all lines, which is all that a prefix filter needs.
2. Lines are numbered in the order of their places (doc_id, line number). Lines of equal word sets are one class, for
   which the first of them stands.
3. Two sets of a Jaccard similarity of s have their first common word among the first n - ceil(s * n) + 1 of each.
   Classes that share a word there meet if what follows it in both still allows the similarity, which bounds
   lengths and places at once, and if the parities of their words in hash buckets differ in no more than the words that
   one of them alone may have. Where many classes of about one size share a word, they meet only the earliest of these
   and the one before at first, which settles groups of near copies in linear work; what is not yet removed meets all
   classes then. Of two sets the smaller has that word in its first ninth, so these words alone are enough for the
   smaller one, and for the first step. A word that many lines may hold is cut into ranges of classes there, so that
   no task holds all of them.
4. What met is verified by the words themselves, read again from the texts. A class similar to an earlier class is
   removed, and so is every place of a class but the first.

Candidates are found by hashes: a word is its level and 58 bits, a class 128 bits of these.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, free_name, read, release, sized, stored

#: Buckets of the rarity sketch, a power of two that Spark's fast hash map holds.
SKETCH = 1 << 16
#: Bits of a word's code below its level: those of its hash.
CODE_BITS = 58
#: Classes of one word that meet in one task, about.
RANGE_ROWS = 20_000
#: Classes of one word and size that meet all with all.
HOT = 100
#: Pairs whose places are broadcast.
FEW = 10_000
#: Slices of the words in which classes meet.
SLICES = 2
#: Words of a set whose parities are taken in twice as many bits.
WIDE = 64
#: Similarity as a fraction.
NUM, DEN = 4, 5
LAST = 2**63 - 1
PARITIES = ("parity", "parity1")


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _spaced(text: Column) -> Column:
    """text with a space for each run of other blanks, so that words and lines are split at one byte each."""
    others = reduce(Column.__or__, (text.contains(x) for x in "\t\x0b\f\r"))
    return F.when(others, F.regexp_replace(text, "[\\t\\x0B\\f\\r]+", " ")).otherwise(text)


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(SKETCH - 1)).cast("int")


def rarity(docs: DataFrame) -> Column:
    """A literal array of the level of each bucket: the logarithm of its count of words."""
    words = docs.select(F.explode(F.split(F.replace(_spaced(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    levels = [0] * SKETCH
    counts = words.select(_bucket(F.xxhash64("w")).alias("b")).groupBy("b").count().toArrow()  # at most SKETCH rows
    for b, n in zip(counts.column("b").to_pylist(), counts.column("count").to_pylist()):
        levels[b] = min(31, int(math.log2(n + 1)))
    return F.from_json(F.lit(json.dumps(levels)), "array<tinyint>")


def _codes(line: Column, levels: Column) -> Column:
    """The words of a line, each once, as whole numbers in the order of rarity: level and hash."""
    hashed = lambda w: F.xxhash64(w).bitwiseAND(F.lit((1 << CODE_BITS) - 1))
    level = lambda h: F.coalesce(F.get(levels, _bucket(h)), F.lit(0).cast("tinyint")).cast("long")
    code = lambda h: F.shiftleft(level(h), CODE_BITS).bitwiseOR(h)
    # Codes that can't be null are made distinct and sorted as plain numbers.
    codes = F.transform(F.transform(F.split(line, " "), hashed), code)
    return F.sort_array(F.array_remove(F.array_distinct(codes), code(hashed(F.lit("")))))


def _prefix(n: Column) -> Column:
    return n - F.ceil(n * NUM / DEN).cast("int") + 1


def _lines(docs: DataFrame, levels: Column) -> DataFrame:
    """(doc_id, th, line, c, k, k2, n, head, parity, parity1): lines with words; k, k2 tell sets apart, head has the rarest words that the filter needs.

    c numbers the lines in the order of their places: a range of doc_id is one partition.
    """
    place = F.posexplode(F.split(_spaced(F.col("text")), "\n")).alias("line", "l")
    placed = docs.repartitionByRange("doc_id").select("doc_id", "th", place).sortWithinPartitions("doc_id", "line", "th")
    # Lines without words go by their text, as a filter by their words would make these twice.
    found = placed.withColumn("c", F.monotonically_increasing_id()).filter(F.trim("l") != "").select("doc_id", "th", "line", "c", _codes(F.col("l"), levels).alias("toks"))
    n = F.size("toks")
    parity = lambda of: F.aggregate("toks", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", of(x), x.bitwiseAND(F.lit(63)).cast("int"))))
    # Of long sets also the parities of the words whose hash has bit 6.
    wide = F.when(n >= WIDE, parity(lambda x: F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(1).cast("long"))))
    parities = parity(lambda x: F.lit(1).cast("long")), wide
    # Sets of fewer than four words are similar only when equal.
    head = F.when(n >= NUM, F.slice("toks", F.lit(1), _prefix(n)))
    return found.select("doc_id", "th", "line", "c", F.xxhash64("toks").alias("k"), F.xxhash64("toks", F.lit(1)).alias("k2"), n.alias("n"), head.alias("head"), *(x.alias(name) for x, name in zip(parities, PARITIES)))


def _classes(lines: DataFrame) -> DataFrame:
    """(doc_id, th, line, c, at_first, again): c is the number of a line; its class is at_first at the line that stands for it, and again at places after its first.

    n, head and parities are there for lines at_first only.
    """
    by = Window.partitionBy("k", "k2").orderBy("c")
    first = F.row_number().over(by) == 1
    again = (F.col("doc_id") != F.first("doc_id").over(by)) | (F.col("line") != F.first("line").over(by))
    marked = lines.withColumns({"at_first": first, "again": again})
    return marked.select("doc_id", "th", "line", "c", "at_first", "again", *(F.when(F.col("at_first"), F.col(x)).alias(x) for x in ("n", "head", *PARITIES)))


def _may(a: str, b: str) -> Column:
    """Whether this word may be the first in common of similar sets a and b, by what follows it, and by parity."""
    c = lambda side, name: F.col(f"{side}.{name}")
    both = c(a, "n") + c(b, "n")
    # Words in common at least, for this similarity: both * NUM / (NUM + DEN); none of them comes before this one.
    place = F.least(c(a, "left"), c(b, "left")) * (NUM + DEN) >= both * NUM
    # Words in one of the sets only: one at least in each bucket where their parity is odd.
    every, one = (c(a, x).bitwiseXOR(c(b, x)) for x in PARITIES)
    bits = F.coalesce(F.bit_count(one) + F.bit_count(every.bitwiseXOR(one)), F.bit_count(every))
    return place & (bits * (NUM + DEN) <= both * (DEN - NUM))


def _tokens(classes: DataFrame, *more: str) -> DataFrame:
    """(t, i, c, n, left, parities, more): a row for each prefix word t of each class, its place i, and the words from it on."""
    rows = classes.filter("head is not null").select("c", "n", *PARITIES, *more, F.posexplode("head").alias("i", "t"))
    return rows.select("t", "i", "c", "n", (F.col("n") - F.col("i")).alias("left"), *PARITIES, *more)


def _short(tokens: DataFrame) -> DataFrame:
    """Of tokens those that a set needs to meet similar ones that are as large or larger."""
    return tokens.filter(F.col("left") * (NUM + DEN) >= F.col("n") * (2 * NUM))


def _size(n: Column) -> Column:
    """A class of set sizes: the whole logarithm to the base DEN / NUM, which similar sets differ in by one at most."""
    return F.floor(F.log(n) / math.log(DEN / NUM)).cast("int")


def _first_tokens(classes: DataFrame) -> DataFrame:
    """The tokens of the first step; t tells words and sizes apart. Words that may be frequent, by their level, are cut into parts."""
    parts = F.ceil(F.pow(F.lit(2.0), F.shiftrightunsigned("t", CODE_BITS) + 1) / RANGE_ROWS).cast("long")
    part = F.when(parts > 1, F.pmod(F.xxhash64(F.shiftright("c", 10)), parts)).otherwise(F.lit(0).cast("long"))
    return _short(_tokens(classes)).withColumn("t", F.xxhash64("t", _size(F.col("n")), part))


def _crowded(classes: DataFrame) -> DataFrame:
    """(t): words of the first step that more than HOT classes of one size share; fewer meet in _rest in bounded work."""
    return _first_tokens(classes).groupBy("t").count().filter(F.col("count") > HOT).select("t")


def _near(classes: DataFrame, crowded: DataFrame) -> DataFrame:
    """(c, g): each class with the first and the one before of those that share a crowded word and have about its size."""
    rows = _first_tokens(classes).join(sized(crowded), "t", "left_semi").select("t", "c", F.struct("c", "n", "left", *PARITIES).alias("a"))
    by = Window.partitionBy("t").orderBy("c")
    met = rows.withColumns({"p": F.first("a").over(by), "q": F.lag("a", 1).over(by)}).filter("q is not null")
    may = lambda x: (F.col(f"{x}.c") < F.col("a.c")) & _may("a", x)
    return met.select("a.c", F.explode(F.array(*(F.when(may(x), F.col(f"{x}.c")) for x in ("p", "q")))).alias("g")).filter("g is not null")


def _rest(classes: DataFrame, slice_: int) -> DataFrame:
    """(c, g): classes not settled with all earlier classes of their prefix words, for one slice of these. Settled classes have settled.

    Each pair meets once, the larger set by all its prefix words with the smaller by fewer, each under its word and the
    sizes that the larger may have. These are hashed and not sorted: few classes share a word and a size, as rare words
    come first.
    """
    rows = _tokens(classes, "settled")
    # Sizes of larger sets for which what follows the word in the smaller still allows the similarity.
    most = F.floor(F.col("left") * (NUM + DEN) / NUM) - F.col("n")
    under = lambda df, size: df.withColumn("t", F.xxhash64("t", size)).filter(F.pmod("t", F.lit(SLICES)) == slice_).drop("i", "size")
    large = under(rows, _size(F.col("n"))).alias("a")
    small = under(_short(rows).withColumn("size", F.explode(F.sequence(_size(F.col("n")), _size(most)))), F.col("size")).alias("b").hint("shuffle_hash")
    c = lambda name: (F.col(f"a.{name}"), F.col(f"b.{name}"))
    (n, n2), (at, at2), (settled, settled2) = c("n"), c("c"), c("settled")
    once = (n2 < n) | ((n2 == n) & (at2 < at))
    asked = ~F.when(at2 < at, settled).otherwise(settled2)
    met = large.join(small, (F.col("a.t") == F.col("b.t")) & once & _may("a", "b") & asked)
    return met.select(F.greatest(at, at2).alias("c"), F.least(at, at2).alias("g"))


def _hint(rows: DataFrame) -> str:
    """How the smaller side of a join comes to the larger: whole if it has few rows, else both by their keys."""
    return "broadcast" if rows.count() <= FEW else "shuffle_hash"


def _removed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(c, doc_id, th, line): the later class c of each pair (c, g) whose sets of words are similar, and its place.

    The pairs are stored, so that Spark knows their size when it chooses how to bring the words to them.
    """
    pairs = stored(pairs.distinct())
    hint = _hint(pairs)
    asked = pairs.select("c").unionByName(pairs.select(F.col("g").alias("c"))).distinct()
    places = classes.filter("at_first").select("c", "doc_id", "th", "line").join(asked.hint(hint), "c")
    places = places.groupBy("doc_id", "th").agg(F.collect_list(F.struct("c", "line")).alias("at"))
    lines = docs.join(places.hint(hint), ["doc_id", "th"]).withColumn("ls", F.split(_spaced(F.col("text")), "\n"))
    taken = F.transform("at", lambda x: F.struct(x["c"].alias("c"), x["line"].alias("line"), F.get("ls", x["line"]).alias("l")))
    words = stored(lines.select("doc_id", "th", F.explode(taken).alias("at")).select("at.c", "doc_id", "th", "at.line", F.array_distinct(_words(F.col("at.l"))).alias("w")))
    release(docs.sparkSession)
    one, two = words.join(pairs, "c"), words.select(F.col("c").alias("g"), F.col("doc_id").alias("doc_id2"), F.col("line").alias("line2"), F.col("w").alias("w2"))
    similar = F.size(F.array_intersect("w", "w2")) * (NUM + DEN) >= (F.size("w") + F.size("w2")) * NUM
    elsewhere = (F.col("doc_id") != F.col("doc_id2")) | (F.col("line") != F.col("line2"))
    found = stored(one.join(two, "g").filter(elsewhere & similar).select("c", "doc_id", "th", "line").distinct())
    discard(words, pairs)
    release(docs.sparkSession)
    return found


def similar_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line): places of lines that are similar or equal to an earlier one.

    docs: doc_id (long, not null), th (a hash of the text), text (not null).
    """
    spark = docs.sparkSession
    classes = stored(_classes(_lines(docs, rarity(docs))), deltas=True, dictionaries=False)
    release(spark)
    crowded = stored(_crowded(classes))
    near = _removed(_near(classes, crowded), classes, docs)
    discard(crowded)
    marked = classes.filter("head is not null").join(near.select("c", F.lit(True).alias("settled")).hint(_hint(near)), "c", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    marked = stored(marked.select("c", "n", "settled", "head", *PARITIES), deltas=True, dictionaries=False)
    release(spark)
    rest = []
    for k in range(SLICES):  # one after the other, as the words of all would fill the disks with shuffle files
        rest.append(stored(_rest(marked, k).distinct()))
        release(spark)
    discard(marked)
    last = _removed(reduce(DataFrame.unionByName, rest), classes, docs)
    places = [x.select("doc_id", "th", "line") for x in (classes.filter("again"), near, last)]
    found = stored(reduce(DataFrame.unionByName, places))
    discard(classes, near, last, *rest)
    return found


def remove_similar_lines(docs: DataFrame, into: str = "line_dedup") -> DataFrame:
    """docs with a struct column `into` added: kept (the text of the lines that stay), n_lines and n_removed.

    A line is removed when an earlier line, by (doc_id, line number), has a Jaccard similarity of words of 0.8 or more;
    lines are judged on the input, and lines without words stay. Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Null and
    empty texts have no lines and kept is empty. A null doc_id comes last; rows of equal doc_id and text are treated
    alike, and equal places of rows that share only the doc_id don't remove each other. Texts and lines of any length are
    taken whole. No rows, no rows. Other columns pass through whatever their names; a column named `into` is an error.
    """
    if into in docs.columns:
        raise ValueError(f"docs has a column {into} already")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    place = F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(_text(docs)).alias("th")
    places = similar_lines(docs.select(*place, _text(docs).alias("text")))
    gone = stored(places.groupBy("doc_id", "th").agg(F.collect_set("line").alias("gone")))
    discard(places)
    release(docs.sparkSession)
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    lines = F.split(text, "\n")
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    added = F.struct(kept.alias("kept"), F.when(text == "", 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    return docs.select(row.alias("row"), *place).join(gone.hint("shuffle_hash"), ["doc_id", "th"], "left").select("row.*", added.alias(into))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs without the lines that remove_similar_lines removes; columns as before, text and n_chars (where it exists) renewed where lines went."""
    name = free_name(docs, "line_dedup")
    found = remove_similar_lines(docs, name)
    less = F.col(f"{name}.n_removed") > 0
    renew = {"text": F.when(less, F.col(f"{name}.kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        renew["n_chars"] = F.when(less, F.length(f"{name}.kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(renew).drop(name)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_similar_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.sha2("line_dedup.kept", 256).alias("kept_sha256"))
