"""Toxicity by a weighted finite-state pattern grammar.

Small transducers for insult, threat, target, negation and reported speech are
composed into one automaton over token classes.  It reads every clause that
holds a lexicon match; what it emits at the clause's end (plain or negated,
direct or reported, aimed at somebody or not) is scored, weighted by the
matched terms.  Insult terms and stems, and the weights of the clause kinds,
are learned from labelled documents."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise
from tessera.llm.simhash import drop_near_duplicates

# Base vocabulary of the grammar (lower case; English, German, French, Spanish).
INSULTS = ("idiot", "moron", "imbecile", "stupid", "scum", "bastard", "asshole", "bitch", "dumbass", "dipshit",
           "arschloch", "dummkopf", "schwachkopf", "trottel", "connard", "salaud", "crétin", "abruti", "imbécil",
           "estúpido", "gilipollas", "cabrón")
THREATS = ("kill you", "hurt you", "beat you", "murder you", "stab you", "shoot you", "destroy you", "burn you",
           "bring dich um", "töte dich", "vais te tuer", "te voy a matar")
TARGETS = frozenset("you your yours yourself u ur he she they them him her people everyone du dich dir dein deine euch ihr "
                    "tu te toi vous ton ta usted ustedes vosotros ellos ellas ils elles".split())
NEGATIONS = frozenset("not no never none isn't aren't wasn't don't doesn't nicht kein keine nie niemals ne pas jamais aucun "
                      "nunca jamás ningún tampoco".split())
REPORTS = frozenset("said says say told tells called calls claimed claims wrote writes quoted reported allegedly sagte sagt "
                    "schrieb nannte behauptet dit disait appelle écrit dijo dice llamó escribió".split())

#: Labelled rows that the lexicon and the weights are fitted on (a hash
#: sample of about this many; all of them if there are fewer).
TRAIN_ROWS = 20_000
MAX_TERMS = 2_000
#: Signed root of a term's log-likelihood ratio (about standard normal for a
#: term that says nothing; thousands of terms are tried), and toxic rows with it.
MIN_Z = 4.5
MIN_ROWS = 5
KEEPS = 0.75
NEGATION_REACH = 3
KINDS = tuple((what, aim, how) for what in ("insult", "threat") for aim in ("aimed", "open")
              for how in ("direct", "reported", "negated"))
#: Prior mean of each clause kind's weight; data moves it.
PRIOR = {"direct": 2.0, "reported": 0.7, "negated": 0.3}

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»]")
_CLAUSE_END = re.compile(r"[.!?;:,\n|]+")
_WORD = re.compile(r"[^\W\d_]+")


# ---------------------------------------------------------------- transducers

def _negation(state: int, symbol: str) -> tuple[int, str]:
    """A negation holds for the next few tokens; a match in reach is marked."""
    if symbol == "N":
        return NEGATION_REACH, symbol
    if symbol in "IT":
        return max(0, state - 1), symbol.lower() if state else symbol
    return max(0, state - 1), symbol


def _reported(state: int, symbol: str) -> tuple[int, str]:
    """From a verb of saying, or inside quotation marks, matches are reported."""
    if symbol == "R":
        return 1, symbol
    if symbol == "Q":
        return 1 - state, symbol
    if symbol in "IT" and state:
        return state, {"I": "J", "T": "U"}[symbol]
    return state, symbol


def _clause(state: tuple[int, int, int], symbol: str) -> tuple[tuple[int, int, int], str]:
    """What the clause holds so far: a target, and the strongest form (3
    direct, 2 reported, 1 negated) of an insult and of a threat."""
    aim, insult, threat = state
    if symbol == "Y":
        aim = 1
    insult = max(insult, {"I": 3, "J": 2, "i": 1}.get(symbol, 0))
    threat = max(threat, {"T": 3, "U": 2, "t": 1}.get(symbol, 0))
    return (aim, insult, threat), symbol


def compose() -> tuple[dict, dict, tuple]:
    """The product automaton: transitions over (state, token class), and the
    clause kinds that each state emits at the clause's end."""
    start = (0, 0, (0, 0, 0))
    moves, emits, todo, seen = {}, {}, [start], {start}
    while todo:
        neg, rep, clause = s = todo.pop()
        aim, insult, threat = clause
        how = {3: "direct", 2: "reported", 1: "negated"}
        emits[s] = tuple(KINDS.index((what, "aimed" if aim else "open", how[level]))
                         for what, level in (("insult", insult), ("threat", threat)) if level)
        for symbol in "ITYNRQW":
            n, out = _negation(neg, symbol)
            r, out = _reported(rep, out)
            c, _ = _clause(clause, out)
            moves[s, symbol] = t = (n, r, c)
            if t not in seen:
                seen.add(t)
                todo.append(t)
    return moves, emits, start


_MOVES, _EMITS, _START = compose()


# -------------------------------------------------------------------- lexicon

@dataclass
class Model:
    #: term -> (symbol I or T, strength 0..1, is a stem: any word that starts with it)
    terms: dict[str, tuple[str, float, bool]]
    weights: list[float] = field(default_factory=list)

    def automaton(self):
        a = ahocorasick.Automaton()
        for term, (symbol, strength, stem) in self.terms.items():
            a.add_word(term, (len(term), symbol, strength, stem))
        a.make_automaton()
        return a


def matches(automaton, low: str) -> dict[int, tuple[int, str, float]]:
    """Start offset of each matched word to (end, class, strength)."""
    found: dict[int, tuple[int, str, float]] = {}
    for end, (length, symbol, strength, stem) in automaton.iter(low):
        start = end - length + 1
        if start and low[start - 1].isalpha():
            continue
        if not stem and end + 1 < len(low) and low[end + 1].isalpha():
            continue
        if start not in found or found[start][2] < strength:
            found[start] = (end + 1, symbol, strength)
    return found


def features(automaton, text: str | None) -> list[float]:
    """Per clause kind the strengths of its matches (log1p of the sum), then
    distinct matched words and matches per hundred words (log1p)."""
    low = (text or "").lower()
    out = [0.0] * (len(KINDS) + 2)
    found = matches(automaton, low)
    if not found:
        return out
    out[-1] = math.log1p(100 * len(found) / (1 + len(low) / 6))
    ends = [m.start() for m in _CLAUSE_END.finditer(low)] + [len(low)]
    starts = sorted(found)
    out[-2] = math.log1p(len({low[s:found[s][0]] for s in starts}))
    at = 0
    for i, end in enumerate(ends):
        begin = ends[i - 1] if i else 0
        inside = []
        while at < len(starts) and starts[at] < end:
            inside.append(starts[at])
            at += 1
        if not inside:
            continue
        state, strength, behind = _START, {"I": 0.0, "T": 0.0}, begin
        for m in _TOKEN.finditer(low, begin, max(end, found[inside[-1]][0])):
            word, s = m.group(), m.start()
            if s in found:
                behind, symbol, value = found[s]
                strength[symbol] += value
            elif s < behind:
                continue  # inside a matched phrase
            else:
                symbol = ("Y" if word in TARGETS else "N" if word in NEGATIONS else "R" if word in REPORTS
                          else "Q" if word in "\"“”«»" else "W")
            state = _MOVES[state, symbol]
        for k in _EMITS[state]:
            out[k] += strength["I" if KINDS[k][0] == "insult" else "T"]
    return [math.log1p(x) for x in out[:len(KINDS)]] + out[-2:]


# ------------------------------------------------------------------- learning

_PHRASES = Model({t: ("T", 1.0, False) for t in THREATS}).automaton()


def _terms_of(text: str | None) -> set[str]:
    """Distinct words (marked ``$``), word beginnings of 3 to 8 letters, and
    phrases of the base vocabulary (marked ``$``)."""
    low = (text or "").lower()
    out = {low[s:e] + "$" for s, (e, _, _) in matches(_PHRASES, low).items()}
    for w in set(_WORD.findall(low)):
        out.add(w + "$")
        out.update(w[:k] for k in range(3, min(len(w), 8) + 1))
    return out


def _count(batches: Iterator[pa.RecordBatch], among: frozenset | None) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()),
                                           pa.array([k[1] for k in counts], pa.int32()),
                                           pa.array(counts.values(), pa.int64())], names=["term", "toxic", "n"])
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            terms = _terms_of(text)
            counts.update((t, toxic) for t in (terms if among is None else terms & among))
            if len(counts) > 200_000:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


def _root_ratio(no: int, yes: int, n: list[int]) -> float:
    """Signed root of the log-likelihood ratio of a term in ``no`` of n[0]
    clean and ``yes`` of n[1] toxic rows against equal shares.  Purity only
    raises it, and it knows no languages: a term of a rare language needs as
    many rows as any other."""
    held, total = no + yes, n[0] + n[1]
    cells = ((no, n[0] * held), (yes, n[1] * held), (n[0] - no, n[0] * (total - held)), (n[1] - yes, n[1] * (total - held)))
    ratio = 2 * sum(k * math.log(k * total / expected) for k, expected in cells if k)
    return math.copysign(math.sqrt(max(0.0, ratio)), yes * n[0] - no * n[1])


def _lift(no: int, yes: int, n: list[int]) -> float:
    return math.log((yes + 0.5) / (n[1] + 1)) - math.log((no + 0.5) / (n[0] + 1))


def _fewest(n: list[int]) -> int:
    """Toxic rows below which not even a term without clean rows is chosen."""
    k = MIN_ROWS
    while k < n[1] and _root_ratio(0, k, n) <= MIN_Z:
        k += 1
    return k


def _chosen(counts: dict[str, list[int]], n: list[int]) -> dict[str, tuple[str, float, bool]]:
    """Terms that mark toxic documents far more often than others, the most
    telling first.  A beginning gives way to the longest word or beginning
    that keeps nearly all of its toxic documents: it says the same with less
    risk for words that the sample does not hold."""
    def toxic(term):
        return counts.get(term, (0, 0))[1]
    longest = {}
    for term in counts:
        word = term.rstrip("$")
        for k in range(3, len(word) + (term != word)):
            stem = word[:k]
            if toxic(term) >= KEEPS * toxic(stem) and len(term) > len(longest.get(stem, "")):
                longest[stem] = term
    scored = {}
    for term, (no, yes) in counts.items():
        z, lift = _root_ratio(no, yes, n), _lift(no, yes, n)
        if yes >= MIN_ROWS and z > MIN_Z and lift > 2:
            scored[term] = (z, lift)
    kept: dict[str, tuple[str, float, bool]] = {}
    for term in sorted(scored, key=lambda t: (-round(scored[t][0], 1), -len(t), t)):
        term = longest.get(term, term)
        if term not in scored:
            continue
        word, stem = term.rstrip("$"), not term.endswith("$")
        if any((word.startswith(k) and s) or (stem and k.startswith(word)) or k == word for k, (_, _, s) in kept.items()):
            continue
        kept[word] = ("I", min(1.0, scored[term][1] / 6), stem)
        if len(kept) >= MAX_TERMS:
            break
    return kept


def _fit(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression, Gaussian prior around PRIOR; Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    mean = np.array([PRIOR[how] * (1.25 if aim == "aimed" else 1) for _, aim, how in KINDS] + [0.0, 0.0, -3.0])
    precision = np.array([0.5] * len(KINDS) + [0.5, 0.5, 0.01])
    w = mean.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + precision * (w - mean)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(precision), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on all rows given (``sample_labelled`` bounds them), near copies
    counted once: else every word of a much copied text would look telling.

    Candidate terms are those in as many toxic rows as a term without clean
    rows needs (``_fewest``), whatever its language; their counts over all
    rows decide, and those of the base vocabulary whether a base word stays.
    Without toxic rows the base vocabulary and the priors stay."""
    rows = materialise(labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("toxic"))
                       .filter(F.col("toxic").isin(0, 1)), "toxic-sample")
    each = rows.withColumn("id", F.xxhash64("toxic", "text"))  # toxic and clean texts apart
    rows = materialise(drop_near_duplicates(each.filter("toxic = 1"), id_col="id")
                       .unionByName(drop_near_duplicates(each.filter("toxic = 0"), id_col="id")).drop("id"), "toxic-train")
    size = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n = [size.get(0, 0), size.get(1, 0)]

    def counted(part: DataFrame, among: frozenset | None) -> DataFrame:
        return part.mapInArrow(lambda it: _count(it, among), "term string, toxic int, n long") \
            .groupBy("term", "toxic").agg(F.sum("n").alias("n"))
    candidates = frozenset(r.term for r in counted(rows.filter("toxic = 1"), None).filter(F.col("n") >= _fewest(n))
                           .select("term").toLocalIterator() if " " not in r.term)
    base = {t: symbol for words, symbol in ((INSULTS, "I"), (THREATS, "T")) for t in words}
    counts: dict[str, list[int]] = {}
    for r in counted(rows, candidates | {t + "$" for t in base}).collect():
        counts.setdefault(r.term, [0, 0])[r.toxic] = r.n
    terms = _chosen({t: c for t, c in counts.items() if t in candidates}, n)
    for word, symbol in base.items():
        # a base word that the labelled texts use innocently stays out
        no, yes = counts.get(word + "$", (0, 0))
        if word not in terms and (not no or _lift(no, yes, n) > 0):
            terms[word] = (symbol, 0.6, False)
    model = Model(terms)
    found = rows.select(_feature_column(model, F.col("text")).alias("x"), "toxic").toPandas()
    if len(found):
        model.weights = _fit(np.array(found["x"].tolist(), float), found["toxic"].to_numpy(float))
    else:
        model.weights = _fit(np.zeros((0, len(KINDS) + 2)), np.zeros(0))
    return model


def sample_labelled(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS, id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Texts and labels of about ``bound`` labelled documents, chosen by a
    hash of the id (all if there are fewer).  Only the ids and labels of the
    sample are broadcast."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(id_col).agg(F.max(label_col).alias(label_col))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.lit(1_000_003)) / F.lit(1_000_003)
    some = known.filter(draw < (bound / n if n else 1.0)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id") \
        .select("text", F.col("label").alias("toxic"))


# -------------------------------------------------------------------- scoring

def _feature_column(model: Model, text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def column(texts: pa.Array) -> pa.Array:
        a = model.automaton()
        return pa.array([features(a, x) for x in texts.to_pylist()], pa.list_(pa.float64()))
    return column(text)


def toxicity_column(model: Model, text: Column) -> Column:
    """The score from 0 to 1 of a text column; null and empty texts get the
    score of a text without matches."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        a, w = model.automaton(), np.array(model.weights)
        x = np.array([features(a, t) + [1.0] for t in texts.to_pylist()]).reshape(len(texts), len(w))
        return pa.array(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), pa.float64())
    return score(text)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """The id, ``score`` and ``predicted`` (score >= threshold) per row; every
    row, null texts and repeated rows too, gets one."""
    return docs.select(F.col(id_col), toxicity_column(model, F.col(text_col)).alias("score")) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more."""
    return docs.filter(toxicity_column(model, F.col(f"`{text_col}`")) < threshold)
