"""Toxicity by a weighted pattern grammar: small transducers over the words of a clause, composed into one.

The insult transducer reads letters: learned words, and learned beginnings followed by
any letters. The others read the classes of words. A clause is scored by what the
composition makes of it, so an insult counts differently if it is aimed at someone,
denied, or only reported.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage_table
from .words import run_hashes, run_starts, slices, span_hashes, split_words

# Labelled rows a model is fitted on, about; entries its insult transducer has at most.
LABELLED, ENTRIES = 100_000, 20_000
# Beginnings of words that may be learned, in letters; whole words have three or more.
BEGINNINGS = range(4, 9)
# Toxic texts an entry must be in, how many times as common it must be there, and the share of
# texts holding it that are toxic when all but that many of its toxic texts are doubted.
SUPPORT, TIMES, SHARE = 4, 8.0, 0.5
# Words between an insult and its target, and words that a denial reaches.
REACH, DENIED = 4, 3
RIDGE = 1e-3

# The closed classes of words, in the four languages of the corpus.
TARGETS = """you your yours yourself u he him she her they them their these those people everyone
du dich dir dein deine ihr euch sie ihn leute tu te toi ton ta vous votre vos il elle ils elles gens
tú ti usted ustedes vosotros él ella ellos ellas gente""".split()
DENIALS = """not no never nobody nor neither without isn aren wasn don doesn didn won nicht kein keine keinen nie niemals ohne
ne pas jamais aucun sans ni nunca jamás tampoco sin""".split()
REPORTS = """said says say saying called calls quoted quote claimed wrote writes reported according
sagte sagt nannte schrieb laut dit disait appelle écrit selon dijo dice llamó escribió según""".split()
INTENTS = """will shall gonna going must should werde werden wird sollte vais va allons doit voy vamos debe""".split()
HARMS = """kill hurt beat destroy burn shoot stab strangle töten umbringen schlagen verprügeln tuer frapper brûler
matar golpear quemar""".split()
# Insults known without labels, with the weight of an entry eight times as common in toxic texts.
KNOWN = "idiot moron scum loser worthless pathetic".split()

OTHER, INSULT, TARGET, DENIAL, REPORT, INTENT, HARM = range(7)
CLASSES = {w: c for c, ws in ((TARGET, TARGETS), (DENIAL, DENIALS), (REPORT, REPORTS), (INTENT, INTENTS), (HARM, HARMS)) for w in ws}
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:,\n\r\"“”„«»()]+")
_LETTERS_AT = re.compile(r"[^\W\d_]*")


# A transducer's step takes its state and a word's class to the next state and what it says: a mark, or 0.
Step = Callable[[int, int], tuple[int, int]]
AIMED, LATE, DENY, TOLD, MEANT = 1, 2, 4, 8, 16


def target_step(left: int, kind: int) -> tuple[int, int]:
    """Marks a match at most REACH words behind a target."""
    return REACH if kind == TARGET else max(0, left - 1), AIMED if left and kind in (INSULT, HARM) else 0


def late_step(left: int, kind: int) -> tuple[int, int]:
    """Marks a target at most REACH words behind a match."""
    if kind == TARGET:
        return 0, LATE if left else 0
    return (REACH, 0) if kind in (INSULT, HARM) else (max(0, left - 1), 0)


def denial_step(left: int, kind: int) -> tuple[int, int]:
    """Marks a match at most DENIED words behind a denial."""
    return DENIED if kind == DENIAL else max(0, left - 1), DENY if left and kind in (INSULT, HARM) else 0


def report_step(open_: int, kind: int) -> tuple[int, int]:
    """Marks every match behind a word of reported speech."""
    open_ = 1 if kind == REPORT else open_
    return open_, TOLD if open_ and kind in (INSULT, HARM) else 0


def intent_step(left: int, kind: int) -> tuple[int, int]:
    """Marks harm at most REACH words behind an intent: a threat."""
    return REACH if kind == INTENT else max(0, left - 1), MEANT if left and kind == HARM else 0


def compose(*steps: Step) -> dict[tuple[int, int], tuple[int, int]]:
    """One transducer that reads what each of ``steps`` reads and says all that they say; state 0 is the start of a clause."""
    start = (0,) * len(steps)
    names, table, todo = {start: 0}, {}, [start]
    while todo:
        state = todo.pop()
        for kind in range(7):
            moved = [step(s, kind) for step, s in zip(steps, state, strict=True)]
            after = tuple(s for s, _ in moved)
            if after not in names:
                names[after] = len(names)
                todo.append(after)
            table[names[state], kind] = names[after], sum(said for _, said in moved)
    return table


GRAMMAR = compose(target_step, late_step, denial_step, report_step, intent_step)


@dataclass(frozen=True)
class Lexicon:
    """Weights of whole words and of beginnings of words."""

    words: dict[str, float]
    beginnings: dict[str, float]

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry in self.words.keys() | self.beginnings.keys():
            found.add_word(entry, len(entry))
        found.make_automaton()
        return found

    def weight(self, word: str) -> float:
        """The weight of the heaviest entry that accepts a word, or 0."""
        starts = [self.beginnings.get(word[:n], 0.0) for n in BEGINNINGS if n <= len(word)]
        return max(self.words.get(word, 0.0), *starts, 0.0)


def _places(text: str, automaton: ahocorasick.Automaton) -> list[int]:
    """Where words begin of which an entry may accept the whole."""
    out, last = [], -1
    for end, size in automaton.iter(text):
        at = end - size + 1
        if at != last and not (at and text[at - 1].isalpha()):
            out.append(at)
            last = at
    return out


FEATURES = ["all", "plain", "aimed", "denied", "told", "threat", "clause", "kinds", "share", "matches"]


def features(text: str, lexicon: Lexicon, automaton: ahocorasick.Automaton) -> list[float]:
    """What the grammar says of a text: weights of its matches by kind, of its worst clause, and how many there are.

    Clauses without a match say nothing and are not read. A threat is harm that is
    intended and aimed; other harm is no match.
    """
    sums = dict.fromkeys(FEATURES, 0.0)
    text = text.lower()
    places = [at for at in _places(text, automaton) if lexicon.weight(_LETTERS_AT.match(text, at)[0])] if len(automaton) else []
    places += [m.start() for m in _HARMS.finditer(text)]
    if not places:
        return [0.0] * len(FEATURES)
    kinds = set()
    for low, high in _clauses(text, sorted(places)):
        total, state, pending = 0.0, 0, None
        for word in _WORD.findall(text, low, high):
            weight = lexicon.weight(word)
            kind = INSULT if weight else CLASSES.get(word, OTHER)
            state, said = GRAMMAR[state, kind]
            if said & LATE and pending and not pending[1] & AIMED:
                sums["aimed"] += pending[0]
                sums["threat"] += bool(pending[1] & MEANT)
                pending = None
            if kind == INSULT:
                kinds.add(word)
                total += weight
                sums["matches"] += 1
                sums["all"] += weight
                sums["plain"] += weight if not said & (DENY | TOLD) else 0.0
                sums["aimed"] += weight if said & AIMED else 0.0
                sums["denied"] += weight if said & DENY else 0.0
                sums["told"] += weight if said & TOLD else 0.0
                pending = weight, said
            elif kind == HARM:
                meant = bool(said & MEANT) and not said & (DENY | TOLD)
                sums["threat"] += meant and bool(said & AIMED)
                pending = (0.0, said) if meant else None
        sums["clause"] = max(sums["clause"], total)
    sums["kinds"] = len(kinds)
    words = text.count(" ") + text.count("\n") + 1
    share = 10.0 * sums["all"] / (10.0 + words**0.5)
    return [share if name == "share" else float(np.log1p(sums[name])) for name in FEATURES]


_HARMS = re.compile(r"\b(?:" + "|".join(HARMS) + r")\b")


def _clauses(text: str, places: list[int]) -> Iterator[tuple[int, int]]:
    """The clauses that hold one of the places, each once."""
    end = 0
    marks = _CLAUSE.finditer(text)
    mark = next(marks, None)
    for at in places:
        if at < end:
            continue
        low = end
        while mark is not None and mark.end() <= at:
            low, mark = mark.end(), next(marks, None)
        end = mark.start() if mark is not None else len(text)
        yield low, end


def _entries(text: str) -> set[str]:
    """Words of a text as ``=word``, and their beginnings as ``^begin``."""
    words = {w for w in _WORD.findall(text.lower()) if len(w) > 2}
    return {"=" + w for w in words} | {"^" + w[:n] for w in words for n in BEGINNINGS if n < len(w)}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task side: texts with an entry by label and fold, summed before they leave the task."""
    sums: dict[tuple[int, int], Counter] = {}

    def out() -> pa.RecordBatch:
        rows = [(fold, entry, many if toxic else 0, 0 if toxic else many) for (fold, toxic), held in sums.items() for entry, many in held.items()]
        sums.clear()
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        types = (pa.int32(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["fold", "entry", "toxic", "clean"])

    for part in slices(batches, "text"):
        for text, toxic, fold in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), part.column("fold").to_pylist(), strict=True):
            sums.setdefault((fold, toxic), Counter()).update(_entries(text or ""))
        if sum(map(len, sums.values())) > 500_000:
            yield out()
    yield out()


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task side: the least hash of three words in a row, which copies and most near copies share."""
    for part in slices(batches, "text"):
        words = split_words(part.column("text"))
        hashes = span_hashes(words.data, words.starts, words.ends)
        at = run_starts(words.first, 3) if len(hashes) > 2 else np.zeros(0, np.int64)
        row = np.searchsorted(words.first, at, side="right") - 1
        least = np.full(part.num_rows, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, row, run_hashes(hashes, 3)[at])
        # A text of less than three words stands for itself.
        short = np.flatnonzero(words.counts < 3)
        least[short] = [sum(hashes[words.first[r] : words.first[r + 1]].tolist()) % 2**64 for r in short]
        columns = [part.column(c) for c in ("key", "text", "toxic")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(least.view(np.int64))], names=["key", "text", "toxic", "print"])


def learn_lexicon(counts: DataFrame, toxic: int, clean: int) -> Lexicon:
    """Entries that mark toxic texts, with the logarithm of how many times as common they are there.

    ``counts`` has ``entry, toxic, clean``. An entry of SUPPORT toxic texts only may be
    chance: that many are left out when its share of toxic texts is looked at. A word is
    left to a beginning that is as heavy, and so is a beginning to a shorter one.
    """
    rate = ((F.col("toxic") + 0.5) / F.lit(toxic + 1.0)) / ((F.col("clean") + 0.5) / F.lit(clean + 1.0))
    sure = (F.col("toxic") - F.lit(SUPPORT - 1)) >= SHARE * (F.col("toxic") - F.lit(SUPPORT - 1) + F.col("clean"))
    kept = counts.withColumn("weight", F.round(F.log(rate), 6)).where((F.col("toxic") >= SUPPORT) & (F.col("weight") >= float(np.log(TIMES))) & sure)
    words, beginnings = dict.fromkeys(KNOWN, float(np.log(TIMES))), {}
    for row in kept.orderBy(F.desc("weight"), "entry").limit(ENTRIES).collect():
        (words if row["entry"][0] == "=" else beginnings)[row["entry"][1:]] = row["weight"]
    held = {
        kind: {e: w for e, w in some.items() if all(beginnings.get(e[:n], 0.0) < w for n in BEGINNINGS if n < len(e))}
        for kind, some in (("words", words), ("beginnings", beginnings))
    }
    return Lexicon(held["words"], held["beginnings"])


def _describe(lexicons, keys: list[str]):
    """Task side: the features of each text by its fold's lexicon, out of a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {fold: (lexicon, lexicon.automaton()) for fold, lexicon in lexicons.value.items()}
        for part in slices(batches, "text"):
            made = [features(t or "", *known[f]) for t, f in zip(part.column("text").to_pylist(), part.column("fold").to_pylist(), strict=True)]
            columns = [part.column(c) for c in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.list_(pa.float64()))], names=[*keys, "features"])

    return run


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...]
    bias: float

    def score(self, found: Column) -> Column:
        """A probability of the features, as a column expression."""
        terms = [F.lit(self.bias), *(F.lit(w) * found[i] for i, w in enumerate(self.weights))]
        return 1 / (1 + F.exp(-sum(terms[1:], terms[0])))


def fit(docs: DataFrame, labels: DataFrame, use: Column, text: str = "text", key: str = "doc_id", label: str = "toxic", size: int = LABELLED) -> Model:
    """A model of the labelled documents for which ``use``, over the labels' columns, holds.

    About ``size`` of them are taken, by a hash of the key: a bound on what is learned
    from, and the reason why the labels can be broadcast. A key with several labels is
    toxic if one is. Documents that share their least hash of three words, and their
    label, count once, so that copies do not make their words look toxic.

    Entries of the insult transducer are words and beginnings that are more common in
    toxic texts. The weights of the grammar's features come from a logistic regression
    in which each half of the texts is described with the entries of the other half.
    Without both labels, one known insult decides.
    """
    spark = docs.sparkSession
    known = labels.where(use & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("toxic"))
    many = known.count()
    part = min(1.0, size / max(many, 1))
    known = known.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1_000_000)) < int(part * 1_000_000))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(known), "key")
    kind = rows.schema["key"].dataType
    printed = T.StructType([*rows.select("key", "text", "toxic").schema.fields, T.StructField("print", T.LongType())])
    rows = stage_table(rows.select("key", "text", "toxic").mapInArrow(_print, printed), "labelled")
    # One row for each print and label; as few as labelled rows, and so is the broadcast.
    once = rows.groupBy("print", "toxic").agg(F.min("key").alias("key"))
    rows = rows.join(F.broadcast(once), ["key", "print", "toxic"]).dropDuplicates(["print", "toxic"])
    rows = stage_table(rows.withColumn("fold", F.pmod(F.xxhash64("print", F.lit(1)), F.lit(2)).cast("int")), "folds")
    sizes = {(r["fold"], r["toxic"] > 0): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    texts = {t: sum(n for (_, label), n in sizes.items() if label == t) for t in (True, False)}
    if not texts[True] or not texts[False]:
        return Model(Lexicon(dict.fromkeys(KNOWN, float(np.log(TIMES))), {}), (2.0, *[0.0] * (len(FEATURES) - 1)), -1.0)
    counted = rows.select("text", F.col("toxic").cast("boolean").alias("toxic"), "fold").mapInArrow(_count, "fold int, entry string, toxic long, clean long")
    counted = stage_table(counted.groupBy("fold", "entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "entries")

    def learned(folds: tuple[int, ...]) -> Lexicon:
        own = counted.where(F.col("fold").isin(*folds)).groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        return learn_lexicon(own, *(sum(sizes.get((f, t), 0) for f in folds) for t in (True, False)))

    whole = learned((0, 1))
    crossed = spark.sparkContext.broadcast({0: learned((1,)), 1: learned((0,))})
    schema = T.StructType([T.StructField("key", kind), T.StructField("toxic", T.IntegerType()), T.StructField("features", T.ArrayType(T.DoubleType()))])
    described = stage_table(rows.select("key", "text", "toxic", "fold").mapInArrow(_describe(crossed, ["key", "toxic"]), schema), "features")
    crossed.unpersist()
    table = described.select(array_to_vector("features").alias("features"), F.col("toxic").cast("boolean").cast("double").alias("label"))
    found = LogisticRegression(regParam=RIDGE, maxIter=100, tol=1e-9).fit(table)
    return Model(whole, tuple(round(float(w), 6) for w in found.coefficients), round(float(found.intercept), 6))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, score, predicted`` of every document; ``predicted`` is 1 from ``threshold`` on.

    The whole text is read, in the task that reads the row; nothing but the model, whose
    size is bounded by ENTRIES, is broadcast. A null or empty text matches nothing and has the score of
    such texts. Rows with the same key, and null keys, are rows like others. An empty
    table gives an empty one. Other columns are not looked at.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.lit(0).alias("fold"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("features", T.ArrayType(T.DoubleType()))])
    held = docs.sparkSession.sparkContext.broadcast({0: model.lexicon})
    scored = rows.mapInArrow(_describe(held, ["key"]), schema).withColumn("score", model.score(F.col("features")))
    return scored.select(F.col("key").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
