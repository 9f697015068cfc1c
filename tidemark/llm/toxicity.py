"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer reads the tokens of a clause and writes a symbol for each: an insult with a learnt weight, a target,
a threat, a negation, a verb of saying, a quotation mark, or another word. Three transducers then rewrite these symbols:

    negation  an insult or threat within NEGATION_REACH tokens after a negation becomes a negated one
    speech    an insult or threat within quotation marks, or after a verb of saying, becomes a reported one
    aim       an insult in a clause with a target becomes an aimed one, after a threat at a target a threatening one

They are composed into one machine beforehand. Every match of a clause has its own label and adds its weight to that
label; the score of a document is a logistic function of these sums, with weights fitted on labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.common import crc_remainder, free_name, read, slices

# Closed word classes of the grammar in English, German, French and Spanish.
TARGET = "you your yours yourself he she they him her them his their du dich dir ihr euch sie dein tu te toi vous votre ton il elle ils usted ustedes tú ti él ella ellos su".split()
NEGATION = "not no never isn't aren't wasn't don't doesn't won't nicht kein keine nie pas jamais non nunca ni".split()
THREAT = {"en": "kill hurt beat destroy shoot stab burn strangle", "de": "töten schlagen verletzen erschießen", "fr": "tuer frapper blesser brûler", "es": "matar golpear destrozar quemar"}
REPORT = {"en": "say claim report call quote shout", "de": "sagen behaupten nennen melden", "fr": "déclarer raconter appeler affirmer", "es": "llamar contar gritar declarar"}
# Forms that the rules below don't make.
IRREGULAR = {"threat": "shot beaten schlägt schlug geschlagen détruire détruit destruir destruye".split(), "report": "said wrote written told schrieb geschrieben nannte genannt dit disait écrit dijo escribió".split()}
# The infinitive's ending of each language, and the endings in its place.
ENDINGS = {"en": ("", " s ed ing"), "de": ("en", "e st t en te ten test tet end"), "fr": ("er", "e es er ons ez ent é ée és ait aient ant era"), "es": ("ar", "o as a amos an ar ando ado ada é ó aron aba ará")}

#: Labelled rows that the lexicon and the weights are fitted on, at most; taken by the hash of their id.
SAMPLE_ROWS = 8000
#: Entries of the learnt lexicon, at most.
LEXICON_ENTRIES = 4000
NEGATION_REACH = 3
THREAT_WEIGHT = 0.5
LABELS = ("bare", "aimed", "threat", "negated", "reported")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]")
_CLAUSE = re.compile(r"[.!?;\n|]+")


def forms(verb: str, language: str) -> list[str]:
    """The verb and its regular forms."""
    old, new = ENDINGS[language]
    stem = verb.removesuffix(old)
    if language == "en":
        double = verb + verb[-1] if re.fullmatch(r"[^aeiou]+[aeiou][bgnpt]", verb) else verb
        stem = verb.removesuffix("e")
        return [verb, verb + "s", (double if double != verb else stem) + "ed", (double if double != verb else stem) + "ing"]
    return [verb, *(stem + e for e in new.split(" ")), *(["ge" + stem + "t"] if language == "de" else [])]


def _classes() -> dict[str, str]:
    found = {}
    for kind, verbs in (("report", REPORT), ("threat", THREAT)):
        found |= {f: kind for language, words in verbs.items() for v in words.split() for f in forms(v, language)}
        found |= dict.fromkeys(IRREGULAR[kind], kind)
    return found | dict.fromkeys(TARGET, "target") | dict.fromkeys(NEGATION, "negation")


_CLASS = _classes()
SYMBOLS = ("word", "target", "negation", "report", "quote", "insult", "threat", "insult negated", "threat negated", "insult reported", "threat reported", "insult aimed", "insult threat", "threat aimed")


class Transducer:
    """A deterministic weighted transducer: arcs[state][symbol] is (next state, symbol written, weight); state 0 begins.

    A symbol without an arc is written as it is, with no weight, and leads to rest[state].
    """

    def __init__(self, arcs: list[dict[str, tuple[int, str, float]]], rest: list[int] | None = None):
        rest = rest or list(range(len(arcs)))
        self.arcs = [{s: a.get(s, (r, s, 0.0)) for s in SYMBOLS} for a, r in zip(arcs, rest)]

    def compose(self, other: "Transducer") -> "Transducer":
        """The transducer that writes what other writes for what this one writes; weights add up."""
        states, arcs = {(0, 0): 0}, []
        for a, b in states_of(states):
            row = {}
            for symbol, (a2, middle, w) in self.arcs[a].items():
                b2, out, v = other.arcs[b][middle]
                row[symbol] = (states.setdefault((a2, b2), len(states)), out, w + v)
            arcs.append(row)
        return Transducer(arcs)

    def run(self, symbols) -> list[tuple[str, float]]:
        """The symbols written, with the weights of their arcs."""
        state, out = 0, []
        for symbol in symbols:
            state, written, weight = self.arcs[state][symbol]
            out.append((written, weight))
        return out


def states_of(states: dict):
    """Keys of a dict that grows meanwhile."""
    done = 0
    while done < len(states):
        yield list(states)[done]
        done += 1


def negation(reach: int) -> Transducer:
    again = {"negation": (reach, "negation", 0.0)}
    deny = [{**again, **{k: (n - 1, f"{k} negated", 0.0) for k in ("insult", "threat")}} for n in range(1, reach + 1)]
    return Transducer([again, *deny], [0, *range(reach)])


def speech() -> Transducer:
    """States: outside, within quotation marks, after a verb of saying."""
    said = {f"{k}{d}": (1, f"{k} reported", 0.0) for k in ("insult", "threat") for d in ("", " negated")}
    told = {k: (2, w, v) for k, (_, w, v) in said.items()}
    return Transducer([{"quote": (1, "quote", 0.0), "report": (2, "report", 0.0)}, {**said, "quote": (0, "quote", 0.0)}, told])


def aim() -> Transducer:
    """States: nothing yet, a target, a threat, a threat and a target. Threats at a target weigh THREAT_WEIGHT."""
    target = lambda to: {"target": (to, "target", 0.0)}
    return Transducer(
        [
            {**target(1), "threat": (2, "threat", 0.0)},
            {**target(1), "insult": (1, "insult aimed", 0.0), "threat": (3, "threat aimed", THREAT_WEIGHT)},
            {"target": (3, "threat aimed", THREAT_WEIGHT), "insult": (2, "insult threat", 0.0)},
            {"insult": (3, "insult threat", 0.0)},
        ]
    )


#: What a written symbol counts as; an insult before the target of its clause is aimed as well.
_LABEL = {"insult": "bare", "insult aimed": "aimed", "insult threat": "threat", "threat aimed": "threat", "insult negated": "negated", "threat negated": "negated", "insult reported": "reported", "threat reported": "reported"}


def _units(text: str) -> set[str]:
    """Whole words (ending in a space) and word beginnings of three to eight letters."""
    out = set()
    for w in set(_TOKEN.findall(text.lower())):
        out.add(w + " ")
        out.update(w[:k] for k in range(3, min(len(w), 8) + 1))
    return out


class Grammar:
    """The lexical transducer, by lexicon (unit -> weight), and the composed machine over its symbols."""

    machine = negation(NEGATION_REACH).compose(speech()).compose(aim())

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.finder = ahocorasick.Automaton()
        for unit in [*lexicon, *(w for w, kind in _CLASS.items() if kind == "threat")]:
            self.finder.add_word(unit.rstrip(), len(unit.rstrip()))
        self.finder.make_automaton()

    def insult(self, token: str) -> float:
        best = self.lexicon.get(token + " ", 0.0)
        for k in range(3, min(len(token), 8) + 1):
            best = max(best, self.lexicon.get(token[:k], 0.0))
        return best

    def matches(self, clause: str) -> list[tuple[str, float]]:
        """(label, weight) of each match of one lower-cased clause, of any length."""
        symbols, weights = [], []
        for token in _TOKEN.findall(clause):
            weight = self.insult(token)
            kind = "insult" if weight > 0 else _CLASS.get(token, "word") if token[0].isalpha() else "quote"
            symbols.append(kind)
            weights.append(weight)
        written = self.machine.run(symbols)
        aimed = "target" in symbols
        found = [(_LABEL[w], weight + arc) for (w, arc), weight in zip(written, weights) if w in _LABEL]
        return [("aimed" if label == "bare" and aimed else label, w) for label, w in found if w > 0]

    def features(self, text: str | None) -> list[float]:
        """For each label the log of its weight; that over all, weight a match, density; whether anything matched; a constant."""
        low = (text or "").lower()
        sums, n = dict.fromkeys(LABELS, 0.0), 0
        for clause in _CLAUSE.split(low):
            # Only clauses in which a known unit begins a word can match.
            if any(not (at := end - size) + 1 or not clause[at].isalpha() for end, size in self.finder.iter(clause)):
                got = self.matches(clause)
                for label, weight in got:
                    sums[label] += weight
                n += bool(got)
        total = sum(sums.values())
        return [*(math.log1p(sums[k]) for k in LABELS), math.log1p(total), total / n if n else 0.0, 1000 * total / (len(low) + 500), float(n > 0), 1.0]


N_FEATURES = len(LABELS) + 5


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights by Newton's method; the constant in the last column isn't shrunk."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, entries: int = LEXICON_ENTRIES):
    """(lexicon, weights) from at most sample_rows labelled rows with crc32(doc_id as text) mod 3 other than 1.

    What reaches the driver is bounded by the two parameters. Without a toxic row the lexicon is empty.
    """
    train = labels.filter("doc_id is not null and toxic in (0, 1)").filter(crc_remainder("doc_id", 3) != 1)
    train = train.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(train), "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic").repartition(12).cache()

    def count(batches):
        for batch in slices(batches):
            got: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for u in _units(text or ""):
                    got[u][toxic] += 1
            yield pa.record_batch([list(got), [x[1] for x in got.values()], [x[0] for x in got.values()]], names=["unit", "hit", "miss"])

    base = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n, n_toxic = int(base[0]), int(base[1])
    least = max(3, round(0.003 * n_toxic))
    units = rows.mapInArrow(count, "unit string, hit long, miss long").groupBy("unit").agg(F.sum("hit").alias("hit"), F.sum("miss").alias("miss"))
    units = units.filter((F.col("hit") >= least) & (F.col("hit") >= 5 * F.col("miss"))).orderBy(F.desc("hit"), F.length("unit"), "unit").limit(entries).collect()
    lexicon: dict[str, float] = {}
    odds = max(n_toxic, 1) / max(n - n_toxic, 1)
    for unit, hit, miss in units:
        weight = math.log((hit + 0.5) / (miss + 0.5) / odds)
        if not any(lexicon.get(unit[:k], -9) >= weight - 0.7 for k in range(3, len(unit))):
            lexicon[unit] = round(weight, 4)
    lexicon = {u: w / 5 for u, w in lexicon.items() if w > 0}

    def featurise(batches):
        grammar = Grammar(lexicon)
        for batch in slices(batches):
            yield pa.record_batch([pa.array([grammar.features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    got = rows.mapInArrow(featurise, "x array<double>, toxic int").collect()
    rows.unpersist()
    x = np.array([r[0] for r in got]).reshape(-1, N_FEATURES)
    return lexicon, fit_logistic(x, np.array([float(r[1]) for r in got]))


def score(docs: DataFrame, model, into: str = "score") -> DataFrame:
    """docs with `into` (0 to 1) added; null and empty texts have the score of a text without a match, long texts are read whole.

    Other columns pass through; one that is named `into` is an error.
    """
    if into in docs.columns:
        raise ValueError(f"docs has a column {into} already")
    lexicon, weights = model

    def run(batches):
        grammar = Grammar(lexicon)
        for batch in slices(batches):
            x = np.array([grammar.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, N_FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, into])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(into, DoubleType())]))


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs' doc_id and text with score; the model is learnt from labels.

    Null and empty texts are scored as texts without a match; repeated rows are scored alike; an empty docs gives no
    rows, empty labels a constant score. Further columns are not read.
    """
    return score(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs, labels))


def op7_toxicity(spark: SparkSession, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    found = detect(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", (crc_remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without those of a score of threshold or more; columns as before, whatever their names."""
    name = free_name(docs, "score")
    return score(docs, fit(docs, labels), name).filter(F.col(f"`{name}`") < threshold).drop(name)
