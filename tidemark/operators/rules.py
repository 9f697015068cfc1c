"""Rules over names, texts and feedback: naming, glossary, dictionaries, personal data, time and policy filters, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rounding import half_up
from tidemark.sources.tables import audit, table

# Categories of personal data by parts of names, the strongest first.
PII_NAMES = [
    ("주민등록번호(RRN)", "jumin rrn resident_reg ssn social_security 주민 주민등록"),
    ("여권번호", "passport 여권"),
    ("운전면허", "driver_license license_no 면허"),
    ("신용카드", "card_no cardno creditcard credit_card pan 카드번호 카드"),
    ("계좌번호", "account_no acct_no accountno iban 계좌 계좌번호"),
    ("이메일", "email e_mail 이메일"),
    ("전화번호", "phone mobile _tel tel_ phone_no cellphone 전화 휴대 핸드폰 연락처"),
    ("주소", "address addr postal zipcode zip_code 주소 우편번호"),
    ("생년월일", "birth dob birthday 생년월일 생일"),
    ("성명/이름", "first_name last_name full_name cust_name user_name 성명 고객명 이름 홍길동"),
]


def singular(c: Column) -> Column:
    """A name without its plural ending: -ies to -y, -ses to -s, and -s but not -ss."""
    low, n = F.lower(c), F.length(c)
    cut = lambda k: F.left(c, n - k)
    return F.when(low.endswith("ies") & (n > 3), F.concat(cut(F.lit(3)), F.lit("y"))).when(low.endswith("ses") & (n > 3), cut(F.lit(2))).when(low.endswith("s") & ~low.endswith("ss") & (n > 1), cut(F.lit(1))).otherwise(c)


def expanded(name: Column, abbreviations: dict[str, str]) -> Column:
    """The words that the parts of an upper-case snake name stand for; parts that aren't known are left out."""
    known = F.create_map(*(F.lit(x) for kv in abbreviations.items() for x in kv))
    return F.array_join(F.array_compact(F.transform(F.split(name, "_"), lambda t: F.try_element_at(known, t))), " ")


def glossary(tokens: Column, groups: list[list[str]]) -> Column:
    """tokens with all terms of each group of synonyms of which one is part of a token, or a token part of it; without repeats."""
    def met(group: list[str]):
        return lambda t: reduce(lambda a, b: a | b, (F.contains(F.lower(t), F.lit(x.lower())) | F.contains(F.lit(x.lower()), F.lower(t)) for x in group))

    words, none = F.filter(tokens, lambda t: t != ""), F.array().cast("array<string>")
    terms = [F.when(F.exists(words, met(g)), F.array(*map(F.lit, g))).otherwise(none) for g in groups]
    return F.array_distinct(F.concat(tokens, *terms))


def code_entries(text: Column) -> Column:
    """(code, label) of "code:label, ..."; the code is the word at the end of what stands before the colon, in upper case."""
    parts = F.transform(F.split(text, ","), lambda p: F.split(p, ":", 2))
    made = F.transform(F.filter(parts, lambda p: (F.size(p) == 2) & p[0].rlike(r"[A-Za-z0-9_]+\s*$")), lambda p: F.struct(F.upper(F.regexp_extract(p[0], r"([A-Za-z0-9_]+)\s*$", 1)).alias("code"), F.trim(p[1]).alias("label")))
    return made


def exhaustive(text: Column) -> Column:
    """Whether a dictionary is complete: two entries or more, and four of five parts are entries."""
    n = F.size(code_entries(text))
    return (n >= 2) & (n / F.size(F.split(text, ",")) >= 0.8)


def date_semantics(name: str, kind: str, length: str, well_known: tuple[str, ...] = ()) -> Column:
    """The kind of time a column holds, by its type and name; empty where none."""
    text = f"(startswith({kind}, 'VARCHAR') OR startswith({kind}, 'CHAR'))"
    known = f"{name} IN ({', '.join(repr(x) for x in well_known)})" if well_known else "false"
    return F.expr(
        f"CASE WHEN {kind} = 'DATE' THEN 'DATE' WHEN startswith({kind}, 'TIMESTAMP') THEN 'TIMESTAMP' WHEN endswith({name}, '_DT_TM') OR (startswith({kind}, 'VARCHAR') AND {length} = '14' AND contains({name}, 'DT')) THEN 'DATETIME_YYYYMMDDHH24MISS' "
        f"WHEN contains({name}, 'YR_MON') OR (endswith({name}, '_MON') AND {length} IN ('6', '')) THEN IF({text}, 'MONTH_YYYYMM', '') WHEN endswith({name}, '_DT') OR {known} THEN IF({text}, 'DATE_YYYYMMDD', '') ELSE '' END"
    )


def pii_category(*names: Column) -> Column:
    """The first category of personal data that any of the names is about; null where none is."""
    about = lambda words: reduce(lambda a, b: a | b, (F.contains(F.lower(n), F.lit(w)) for n in names for w in words.split()))
    return reduce(lambda c, kv: F.when(F.coalesce(about(kv[1]), F.lit(False)), kv[0]).otherwise(c), reversed(PII_NAMES), F.lit(None).cast("string"))


def minimum_span(words: DataFrame, key: list[str], labels: list[str], needed: int) -> DataFrame:
    """(key, span): the fewest consecutive words (key, pos, word) that hold `needed` of the labels; keys that hold fewer don't come."""
    w = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = F.array_compact(F.array(*(F.last(F.when(F.col("word") == x, F.col("pos")), True).over(w) for x in labels)))
    spans = words.filter(F.col("word").isin(*labels)).select(*key, (F.col("pos") - F.get(F.sort_array(last, False), F.lit(needed - 1)) + 1).alias("span"))
    return spans.groupBy(*key).agg(F.min("span").cast("long").alias("span")).filter("span is not null")


def policy(df: DataFrame, deleted: str | None = None, valid: str | None = None, excluded: str | None = None, period: tuple[str, str, str] | None = None) -> DataFrame:
    """Rows in force: not deleted, not marked invalid (N), without an exclusion, and with start <= day < end for period (start, end, day)."""
    rules = [F.col(deleted).isNull()] if deleted else []
    rules += [F.coalesce(valid, F.lit("Y")) != "N"] if valid else []
    rules += [F.col(excluded).isNull()] if excluded else []
    rules += [(F.col(period[0]) <= F.lit(period[2]).cast("date")) & (F.col(period[1]) > F.lit(period[2]).cast("date"))] if period else []
    return df.filter(reduce(lambda a, b: a & b, rules, F.lit(True)))


def in_time(c: Column, semantic: str, first: str, last: str) -> Column:
    """Whether c lies in the days first to last (YYYYMMDD): half-open for dates and times, closed for strings of digits."""
    day = lambda x: F.to_date(F.lit(x), "yyyyMMdd")
    if semantic in ("DATE", "TIMESTAMP"):
        return (c >= day(first)) & (c < F.date_add(day(last), 1))
    if semantic == "MONTH_YYYYMM":
        return c.between(first[:6], last[:6])
    if semantic == "DATETIME_YYYYMMDDHH24MISS":
        return (c >= first + "000000") & (c < F.concat(F.date_format(F.date_add(day(last), 1), "yyyyMMdd"), F.lit("000000")))
    return c.between(first, last)


def near_ties(found: DataFrame, by: str, share: float = 0.92) -> DataFrame:
    """Groups whose best score above 0 is met by others within `share` of it: how many, and the best."""
    best = F.max("score").over(Window.partitionBy(by))
    near = found.withColumn("best", best).filter((F.col("best") > 0) & (F.col("score") >= F.col("best") * share))
    return near.groupBy(by).agg(F.count(F.lit(1)).alias("tied"), F.max("best").alias("best")).filter("tied > 1")


def recall_at(expected: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """One row: cases, those with a hit, and the mean share of expected items (case, item) among the first k ranked ones."""
    met = expected.join(ranked.filter(F.col("rank") <= k).select("case", "item").withColumn("hit", F.lit(1)), ["case", "item"], "left")
    per = met.groupBy("case").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("hits") > 0).alias("hit_cases"), half_up(F.sum(F.floor(F.col("hits") * 1000000 / F.col("n"))) / F.count(F.lit(1)) / 1000000, 4).alias("recall"))


def misses(expected: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """Items missed by category: absent, or ranked after k; with the cases it happens in."""
    met = expected.join(ranked.select("case", "item", "rank"), ["case", "item"], "left").filter((F.col("rank") > k) | F.col("rank").isNull())
    return met.groupBy(F.when(F.col("rank").isNull(), "absent").otherwise("ranked_low").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("case").alias("cases"))


def top_with_exclusions(found: DataFrame, by: str, k: int, more: int = 5) -> DataFrame:
    """The first k of each group by score, ties by item, and the next `more` marked as left out."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "item")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k + more).select(by, "item", "rank", (F.col("rank") > k).alias("excluded"))


def learned_errors(log: DataFrame, least: int = 3, slow_ms: int = 5000) -> DataFrame:
    """(kind, profile, sql_hash, n): errors and slow calls that recur `least` times or more for a profile and statement."""
    kind = F.when(~F.col("success"), "recurring_error").when(F.col("elapsed_ms") >= slow_ms, "slow")
    return log.select(kind.alias("kind"), "profile", "sql_hash").filter("kind is not null").groupBy("kind", "profile", "sql_hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def usage(records: DataFrame) -> DataFrame:
    """Records that use each item of their list, an item counted once a record."""
    return records.select(F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def clarifications(answers: DataFrame, n: int = 20) -> DataFrame:
    """Questions asked twice or more: how often, the commonest answer (ties by answer) and when last; the most frequent n."""
    by = answers.groupBy("id", "answer").agg(F.count(F.lit(1)).alias("k"), F.max("at").alias("at"))
    out = by.groupBy("id").agg(F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("m"), "answer"))["answer"].alias("answer"), F.max("at").alias("last"))
    return out.filter("n >= 2").orderBy(F.desc("n"), "id").limit(n)


def first_of(rows: DataFrame, fingerprint: str, order: str) -> DataFrame:
    """The first row of each fingerprint, in order."""
    return rows.groupBy(fingerprint).agg(F.min_by(F.struct(*(c for c in rows.columns if c != fingerprint)), order).alias("x")).select(fingerprint, "x.*")


def gate(violations: list[DataFrame]) -> DataFrame:
    """(code, n, blocks) of lists of violations (code, block): what fails a quality gate."""
    both = reduce(DataFrame.unionByName, violations)
    return both.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.bool_or("block").alias("blocks"))


def few_shot(samples: DataFrame, question: list[str], intents: list[str], n: int = 5) -> DataFrame:
    """Samples (id, words, intents, text) by word hits, 10 for the same text and 2 for each common intent; the best n above 0, ties by id."""
    common = lambda c, words: F.size(F.array_intersect(c, F.array(*map(F.lit, words))))
    score = common(F.col("words"), question) + F.when(F.lower("text") == " ".join(question), 10).otherwise(0) + 2 * common(F.col("intents"), intents)
    return samples.select("id", score.cast("long").alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(n)


_ABBR = {"RED": "colour", "BLUE": "colour", "BOLT": "fastener", "RING": "round part", "SMALL": "size"}
_GROUPS = [["bolt", "screw", "fastener"], ["ring", "washer"], ["gizmo", "gadget", "gizmos"]]
_LABELS = ["the", "de", "der", "of", "la", "and", "in"]
_NAME = "concat(upper(replace(p_name, ' ', '_')), CASE p_size % 5 WHEN 0 THEN '_DT' WHEN 1 THEN '_DT_TM' WHEN 2 THEN '_YR_MON' WHEN 3 THEN '_MON' ELSE '' END)"
_TYPE = "CASE p_partkey % 5 WHEN 0 THEN 'DATE' WHEN 1 THEN 'TIMESTAMP(6)' WHEN 2 THEN 'NUMBER' ELSE 'VARCHAR' END"
_SUFFIX = ["_email", "_tel", "_addr", "_dob", "_card_no", "_iban", "", "_x", "_passport", "_ssn", "full_name", "_license_no"]
_PNAME = "concat(replace(p_name, ' ', '_'), CASE p_size % 12 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_SUFFIX)) + " END)"
_CODES = "concat(p_type, ':', p_name, ', my ', p_brand, IF(p_size % 2 = 0, ':x', ''), ', 1:one')"


def _words(s, d):
    t = table(s, d, "conversations")
    return t.select("conv_id", "turn", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("pos", "word"))


def _ranked(s, d):
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("case"), F.col("l_partkey").alias("item"), "l_extendedprice", "l_linenumber")
    w = Window.partitionBy("case").orderBy(F.desc("l_extendedprice"), "item", "l_linenumber")
    ranked = lines.withColumn("rank", F.row_number().over(w)).filter("l_linenumber <> 2").groupBy("case", "item").agg(F.min("rank").alias("rank"))
    return table(s, d, "lineitem").filter("l_quantity > 30").selectExpr("l_orderkey AS case", "l_partkey AS item").distinct(), ranked


def _policy_rows(s, d):
    return table(s, d, "orders").selectExpr("o_orderkey", "IF(o_orderkey % 7 = 0, o_orderdate, NULL) AS deleted_at", "CASE WHEN o_orderkey % 5 = 0 THEN 'N' WHEN o_orderkey % 3 = 0 THEN 'Y' END AS valid_yn", "IF(o_orderpriority = '5-LOW', 'x', NULL) AS excluded", "CAST(o_orderdate AS date) AS start_day", "date_add(CAST(o_orderdate AS date), 400) AS end_day")


QUERIES = {
    "singularize": lambda s, d: table(s, d, "benchmark").select(F.explode(F.regexp_extract_all(F.col("text"), F.lit("([A-Za-z]+)"), 1)).alias("word")).distinct().select("word", singular(F.col("word")).alias("singular")),
    "expand_names": lambda s, d: table(s, d, "part").select("p_partkey", expanded(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))), _ABBR).alias("phrase")),
    "glossary_expand": lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(F.sort_array(glossary(F.split("p_name", " "), _GROUPS)), " ").alias("terms")),
    "code_dict_parse": lambda s, d: table(s, d, "part").withColumn("text", F.expr(_CODES)).select("p_partkey", F.array_join(F.transform(code_entries(F.col("text")), lambda x: F.concat(x["code"], F.lit("="), x["label"])), ";").alias("codes"), exhaustive(F.col("text")).alias("exhaustive")),
    "date_semantics": lambda s, d: table(s, d, "part").selectExpr("p_partkey", f"{_NAME} AS name", f"{_TYPE} AS kind", "CASE p_partkey % 3 WHEN 0 THEN '14' WHEN 1 THEN '6' ELSE '' END AS length").select("p_partkey", date_semantics("name", "kind", "length", ("SMALL_RING", "RED_BOLT")).alias("semantic")),
    "pii_names": lambda s, d: table(s, d, "part").select("p_partkey", pii_category(F.expr(_PNAME), F.col("p_type")).alias("category")),
    "minimum_span": lambda s, d: minimum_span(_words(s, d), ["conv_id", "turn"], _LABELS, 3),
    "policy_filter": lambda s, d: policy(_policy_rows(s, d), "deleted_at", "valid_yn", "excluded", ("start_day", "end_day", "1998-01-01")).select("o_orderkey"),
    "time_condition": lambda s, d: table(s, d, "orders").select("o_orderkey", in_time(F.col("o_orderdate"), "TIMESTAMP", "19970301", "19970415").alias("as_time"), in_time(F.date_format("o_orderdate", "yyyyMMdd"), "DATE_YYYYMMDD", "19970301", "19970415").alias("as_day"), in_time(F.date_format("o_orderdate", "yyyyMM"), "MONTH_YYYYMM", "19970301", "19970415").alias("as_month"), in_time(F.date_format("o_orderdate", "yyyyMMddHHmmss"), "DATETIME_YYYYMMDDHH24MISS", "19970301", "19970415").alias("as_digits")),
    "near_ties": lambda s, d: near_ties(table(s, d, "orders").select("o_custkey", F.col("o_totalprice").alias("score")), "o_custkey"),
    "recall_at_k": lambda s, d: recall_at(*_ranked(s, d), 3),
    "miss_taxonomy": lambda s, d: misses(*_ranked(s, d), 3),
    "topk_exclusions": lambda s, d: top_with_exclusions(table(s, d, "part").select("p_brand", F.col("p_partkey").alias("item"), F.col("p_size").alias("score")), "p_brand", 8),
    "learned_errors": lambda s, d: learned_errors(audit(s, d), 2, 90),
    "usage_counts": lambda s, d: usage(table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("items"))),
    "clarification_mining": lambda s, d: clarifications(table(s, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("id"), F.col("event_type").alias("answer"), F.col("ts").alias("at"))),
    "feedback_first": lambda s, d: first_of(table(s, d, "events").select("event_id", "user_id", F.sha2("props", 256).alias("fingerprint")), "fingerprint", "event_id"),
    "quality_gate": lambda s, d: gate([table(s, d, "lineitem").join(table(s, d, "part").filter("p_size < 49"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select(F.lit("METRIC_BROKEN").alias("code"), F.lit(True).alias("block")), table(s, d, "orders").join(table(s, d, "customer").filter("c_acctbal > -900"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.lit("JOIN_BROKEN").alias("code"), F.lit(True).alias("block")), table(s, d, "part").filter(F.contains("p_name", F.lit("red"))).select(F.lit("PII_UNCLASSIFIED").alias("code"), F.lit(False).alias("block"))]),
    "few_shot": lambda s, d: few_shot(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("words"), F.array("p_type", "p_brand").alias("intents"), F.col("p_name").alias("text")), ["red", "bolt"], ["SMALL", "Brand#3"], 200),
}


_AUD = "SELECT event_type = 'error' AS failed, floor(value)::BIGINT AS ms, user_id AS profile, substr(sha256(trim(props)), 1, 16) AS sql_hash FROM events"
_TXT = "(starts_with(kind, 'VARCHAR') OR starts_with(kind, 'CHAR'))"
_RK = "WITH l AS (SELECT l_orderkey AS c, l_partkey AS i, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS rk FROM lineitem), r AS (SELECT c, i, min(rk) AS rk FROM l WHERE l_linenumber <> 2 GROUP BY 1, 2), x AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS i FROM lineitem WHERE l_quantity > 30), m AS (SELECT x.c, x.i, rk FROM x LEFT JOIN r ON r.c = x.c AND r.i = x.i)"

ORACLE_SQL = {
    "singularize": "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM benchmark) SELECT word, CASE WHEN lower(word) LIKE '%ies' AND length(word) > 3 THEN left(word, length(word) - 3) || 'y' WHEN lower(word) LIKE '%ses' AND length(word) > 3 THEN left(word, length(word) - 2) WHEN lower(word) LIKE '%s' AND lower(word) NOT LIKE '%ss' AND length(word) > 1 THEN left(word, length(word) - 1) ELSE word END AS singular FROM w",
    "expand_names": "WITH t AS (SELECT p_partkey, unnest(string_split(upper(p_name), ' ')) AS t, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part), e AS (SELECT p_partkey, i, CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ABBR.items()) + " END AS w FROM t) SELECT p_partkey, coalesce(string_agg(w, ' ' ORDER BY i), '') AS phrase FROM e GROUP BY 1",
    "glossary_expand": "WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS t FROM part), g AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, g in enumerate(_GROUPS) for x in g) + ") v(g, x)), h AS (SELECT DISTINCT p_partkey, g FROM t JOIN g ON contains(t, x) OR contains(x, t)), u AS (SELECT p_partkey, t AS w FROM t UNION SELECT p_partkey, x FROM h JOIN g USING (g)) SELECT p_partkey, string_agg(w, ' ' ORDER BY w) AS terms FROM u GROUP BY 1",
    "code_dict_parse": "SELECT p_partkey, upper(p_type) || '=' || p_name || CASE WHEN p_size % 2 = 0 THEN ';' || substr(p_brand, 7) || '=x' ELSE '' END || ';1=one' AS codes, p_size % 2 = 0 AS exhaustive FROM part",
    "date_semantics": f"WITH c AS (SELECT p_partkey, {_NAME} AS name, {_TYPE} AS kind, CASE p_partkey % 3 WHEN 0 THEN '14' WHEN 1 THEN '6' ELSE '' END AS len FROM part) SELECT p_partkey, CASE WHEN kind = 'DATE' THEN 'DATE' WHEN starts_with(kind, 'TIMESTAMP') THEN 'TIMESTAMP' WHEN ends_with(name, '_DT_TM') OR (starts_with(kind, 'VARCHAR') AND len = '14' AND contains(name, 'DT')) THEN 'DATETIME_YYYYMMDDHH24MISS' WHEN contains(name, 'YR_MON') OR (ends_with(name, '_MON') AND len IN ('6', '')) THEN CASE WHEN {_TXT} THEN 'MONTH_YYYYMM' ELSE '' END WHEN ends_with(name, '_DT') OR name IN ('SMALL_RING', 'RED_BOLT') THEN CASE WHEN {_TXT} THEN 'DATE_YYYYMMDD' ELSE '' END ELSE '' END AS semantic FROM c",
    "pii_names": f"WITH n AS (SELECT p_partkey, lower({_PNAME}) AS a, lower(p_type) AS b FROM part) SELECT p_partkey, CASE " + " ".join("WHEN " + " OR ".join(f"contains({x}, '{w}')" for x in "ab" for w in words.split()) + f" THEN '{k}'" for k, words in PII_NAMES) + " END AS category FROM n",
    "minimum_span": "WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) AS pos FROM conversations), l AS (SELECT conv_id, turn, pos, [" + ", ".join(f"last_value(CASE WHEN w = '{x}' THEN pos END IGNORE NULLS) OVER z" for x in _LABELS) + "] AS v FROM t WHERE w IN (" + ", ".join(f"'{x}'" for x in _LABELS) + ") WINDOW z AS (PARTITION BY conv_id, turn ORDER BY pos ROWS UNBOUNDED PRECEDING)), s AS (SELECT conv_id, turn, pos - list_reverse_sort(list_filter(v, lambda x: x IS NOT NULL))[3] + 1 AS span FROM l) SELECT conv_id, turn, min(span)::BIGINT AS span FROM s GROUP BY 1, 2 HAVING min(span) IS NOT NULL",
    "policy_filter": "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderpriority <> '5-LOW' AND o_orderdate::DATE <= DATE '1998-01-01' AND o_orderdate::DATE + 400 > DATE '1998-01-01'",
    "time_condition": "SELECT o_orderkey, x AS as_time, x AS as_day, strftime(o_orderdate, '%Y%m') BETWEEN '199703' AND '199704' AS as_month, x AS as_digits FROM (SELECT *, o_orderdate >= DATE '1997-03-01' AND o_orderdate < DATE '1997-04-16' AS x FROM orders)",
    "near_ties": "WITH b AS (SELECT o_custkey, o_totalprice AS score, max(o_totalprice) OVER (PARTITION BY o_custkey) AS best FROM orders) SELECT o_custkey, count(*) AS tied, max(best) AS best FROM b WHERE best > 0 AND score >= best * 0.92::DOUBLE GROUP BY 1 HAVING count(*) > 1",
    "recall_at_k": _RK + ", p AS (SELECT c, count(*) FILTER (WHERE rk <= 3) AS hits, count(*) AS n FROM m GROUP BY 1) SELECT count(*) AS cases, count(*) FILTER (WHERE hits > 0) AS hit_cases, floor(sum(floor(hits * 1000000 / n)) / count(*) / 1000000 * 10000 + 0.5) / 10000 AS recall FROM p",
    "miss_taxonomy": _RK + " SELECT CASE WHEN rk IS NULL THEN 'absent' ELSE 'ranked_low' END AS category, count(*) AS n, count(DISTINCT c) AS cases FROM m WHERE rk IS NULL OR rk > 3 GROUP BY 1",
    "topk_exclusions": "WITH r AS (SELECT p_brand, p_partkey AS item, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part) SELECT *, rank > 8 AS excluded FROM r WHERE rank <= 13",
    "learned_errors": f"WITH a AS ({_AUD}), k AS (SELECT CASE WHEN failed THEN 'recurring_error' WHEN ms >= 90 THEN 'slow' END AS kind, profile, sql_hash FROM a) SELECT kind, profile, sql_hash, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2",
    "usage_counts": "SELECT l_suppkey AS item, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1",
    "clarification_mining": "WITH e AS (SELECT (props->>'$.k')::BIGINT AS id, event_type AS answer, ts FROM events), c AS (SELECT id, answer, count(*) AS k, max(ts) AS seen FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC, answer) AS rn FROM c) SELECT id, sum(k)::BIGINT AS n, max(CASE WHEN rn = 1 THEN answer END) AS answer, max(seen) AS last FROM r GROUP BY 1 HAVING sum(k) >= 2 ORDER BY n DESC, id LIMIT 20",
    "feedback_first": "WITH r AS (SELECT event_id, user_id, sha256(props) AS fingerprint, row_number() OVER (PARTITION BY props ORDER BY event_id) AS rn FROM events) SELECT fingerprint, event_id, user_id FROM r WHERE rn = 1",
    "quality_gate": "WITH v AS (SELECT 'METRIC_BROKEN' AS code, true AS block FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 49) UNION ALL SELECT 'JOIN_BROKEN', true FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -900) UNION ALL SELECT 'PII_UNCLASSIFIED', false FROM part WHERE contains(p_name, 'red')) SELECT code, count(*) AS n, bool_or(block) AS blocks FROM v GROUP BY 1",
    "few_shot": "WITH s AS (SELECT p_partkey AS id, (list_contains(string_split(p_name, ' '), 'red')::INT + list_contains(string_split(p_name, ' '), 'bolt')::INT + CASE WHEN p_name = 'red bolt' THEN 10 ELSE 0 END + 2 * (p_type = 'SMALL')::INT + 2 * (p_brand = 'Brand#3')::INT)::BIGINT AS score FROM part) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 200",
}
