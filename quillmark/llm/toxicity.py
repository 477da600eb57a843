"""Toxicity scores from a lexicon, misspellings and context (operator 6).

The lexicon is learnt: words that occur in far more toxic than clean labelled texts. The Levenshtein
automata of its terms are intersected with their trie, so a misspelling within the allowed edits of a
term is caught without comparing a word with every term. Each hit is
judged by a window of words around it: within quotation marks or after a word of reporting it counts as
quotation, otherwise as abuse, and a word of address near it is counted too. A logistic model over these
counts gives the score.

Labelled texts are bounded by SAMPLE (in expectation, chosen by a hash of the id), so what the driver
sees is bounded by the words of that sample; no term that is sure enough is left out. The label tells
nothing at scoring. Equal texts of the sample count once. The words of a text are runs of letters and
digits, lower-cased; whole texts are read, very long ones too.

Null, empty and hitless texts get the score of a text without hits. With no labels of both kinds the
score is the share of toxic labels (0 if there are none). An empty table gives no rows. Repeated rows
get equal scores. Several labels of one id count as toxic if one is; labels other than 0 and 1 are left
out. A null id is not held out and has no label. Columns named like an output are replaced, others pass through.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.shared import cut, documents, portions

#: Labelled texts that a model is learnt from, in expectation.
SAMPLE = 20_000
#: A term occurs in MIN_TEXTS toxic texts at least, in toxic ones RATIO times as often as in clean ones, and is surer than chance by SURE
#: nats, after allowing for every word that was tried.
MIN_TEXTS, RATIO, SURE = 4, 12.0, 1.0
THRESHOLD = 0.7
TOKEN = re.compile(r"\w+|[\"'“”„«»‘’]")
QUOTES = frozenset("\"'“”„«»‘’")
#: Words that report speech or speak of a word, and words of address.
REPORTING = frozenset("said says wrote called quote quoted quoting word term phrase sagte nannte zitat wort dit appelle mot citation dijo palabra cita".split())
ADDRESS = frozenset("you your youre u du dich dein ihr sie tu te toi vous votre tú tu usted".split())
BEFORE, AFTER = 6, 6
FEATURES = ("exact", "misspelt", "quoted", "addressed", "surest")
KNOWN, STATES = 1 << 18, 1 << 16


class Lexicon:
    """A trie of terms and the Levenshtein automata of all of them at once, walked together.

    A state holds the trie's nodes that the letters read so far may have led to, each with its least
    edits; a letter matches, replaces, is extra, or a term's letter was left out. States and their
    transitions are made when they are first met and kept (up to STATES), so a word costs one look-up
    a letter, and most words end after two or three of them.
    """

    def __init__(self, terms) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]  # edits that the term ending here may have, -1: none ends here
        self.room: list[int] = [0]  # edits that any term below may have
        for term in terms:
            node, edits = 0, allowed(term)
            self.room[0] = max(self.room[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.room.append(0)
                node = self.children[node][c]
                self.room[node] = max(self.room[node], edits)
            self.term[node] = max(self.term[node], edits)
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.first = self.number({0: 0})

    def closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """With the nodes that leaving out letters of a term leads to."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.room[child] and e + 1 < nodes.get(child, 99):
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        return nodes

    def number(self, nodes: dict[int, int]) -> int:
        key = frozenset(self.closed(nodes).items())
        if not key:
            return -1
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return self.numbers[key]

    def step(self, state: int, c: str) -> int:
        after: dict[int, int] = {}
        for node, e in self.states[state]:
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.room[child] and cost < after.get(child, 99):
                    after[child] = cost
            if e + 1 <= self.room[node] and e + 1 < after.get(node, 99):
                after[node] = e + 1
        self.steps[state][c] = out = self.number(after)
        return out

    def edits(self, word: str) -> int:
        """The least edits from the word to a term that allows them; -1 if there is none."""
        if len(self.states) > STATES:
            self.clear()
        state = self.first
        for c in word:
            after = self.steps[state].get(c)
            state = self.step(state, c) if after is None else after
            if state < 0:
                return -1
        return min((e for node, e in self.states[state] if e <= self.term[node]), default=-1)


def allowed(term: str) -> int:
    """Edits that a misspelling of a term of this length may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 12 else 2


class Hits(dict):
    """Word -> 0: no term; a term's evidence (above zero); -1: a misspelt term."""

    def __init__(self, terms: tuple[str, ...], evidence: tuple[float, ...]) -> None:
        self.lexicon = Lexicon(terms)
        self.evidence = dict(zip(terms, evidence, strict=True))

    def __missing__(self, word: str) -> float:
        if len(self) >= KNOWN:
            self.clear()
        edits = self.lexicon.edits(word)
        self[word] = out = self.evidence[word] if edits == 0 else 0.0 if edits < 0 else -1.0
        return out


@lru_cache(2)
def _hits(terms: tuple[str, ...], evidence: tuple[float, ...]) -> Hits:
    return Hits(terms, evidence)


@dataclass
class Model:
    """terms with their evidence, the log of how much more often toxic texts have them; weights of FEATURES."""

    terms: tuple[str, ...]
    evidence: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def hit(self, word: str) -> float:
        return _hits(self.terms, self.evidence)[word]

    def counts(self, text: str | None) -> list[float]:
        if not text or not self.terms:
            return [0.0] * len(FEATURES)
        tokens = TOKEN.findall(text.lower())
        found = list(map(_hits(self.terms, self.evidence).__getitem__, tokens))
        out = dict.fromkeys(FEATURES, 0.0)
        for i in (i for i, e in enumerate(found) if e):
            before, after = tokens[max(0, i - BEFORE) : i], tokens[i + 1 : i + 1 + AFTER]
            quoted = any(t in QUOTES for t in before) and any(t in QUOTES for t in after) or any(t in REPORTING for t in before)
            if quoted:
                out["quoted"] += 1
            elif found[i] > 0:
                out["exact"] += found[i]
                out["surest"] = max(out["surest"], found[i])
            else:
                out["misspelt"] += 1
            out["addressed"] += not quoted and any(t in ADDRESS for t in (*before, *after))
        return [math.log1p(v) for v in out.values()]

    def score(self, text: str | None) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, self.counts(text), strict=True))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def _word_counts(batches):
    for b in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for w in set(TOKEN.findall(text.lower())):
                counts.setdefault(w, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1))], names=["word", "clean", "toxic"])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps."""
    a, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    keep = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + keep * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(keep)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def learn(train: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """A model from the labelled rows of ``train``."""
    known = labels.where(F.col(toxic).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    total = known.count()
    if not total:
        return Model((), (), (0.0,) * len(FEATURES), -30.0)
    few = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.lit(min(1.0, SAMPLE / total) * (1 << 30)))
    pairs = train.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null").join(few, "key")
    rows = cut(pairs.groupBy("text").agg(F.max("toxic").alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n, p = sizes.get(0, 0), sizes.get(1, 0)
    if not n or not p:
        return Model((), (), (0.0,) * len(FEATURES), 30.0 if p else -30.0)
    counted = rows.select("text", "toxic").mapInArrow(_word_counts, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = ((F.col("toxic") + 0.5) / (p + 1)) / ((F.col("clean") + 0.5) / (n + 1))
    base, both = p / (n + p), F.col("toxic") + F.col("clean")
    sure = F.col("toxic") * F.log(F.col("toxic") / both / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / both / (1 - base))).otherwise(0.0)
    able = counted.where((F.col("toxic") >= MIN_TEXTS) & (F.length("word") >= 3) & ~F.col("word").rlike("^[0-9_]+$")).select("word", "clean", "toxic", ratio.alias("ratio"), sure.alias("sure"))
    tried = able.count()
    terms = able.where((F.col("ratio") >= RATIO) & (F.col("sure") >= math.log(max(tried, 1)) + SURE)).select("word", "ratio").collect()
    terms = sorted((r["word"], math.log(r["ratio"])) for r in terms)
    model = Model(tuple(t for t, _ in terms), tuple(e for _, e in terms), (0.0,) * len(FEATURES), 0.0)
    data = counts(rows.select("text", "toxic"), model).select("toxic", "counts").collect()
    w, bias = fit(np.array([r["counts"] for r in data]), np.array([r["toxic"] for r in data], float))
    return Model(model.terms, model.evidence, tuple(w.tolist()), bias)


def _over(df: DataFrame, name: str, kind: T.DataType, text: str, of) -> DataFrame:
    rest = [c for c in df.columns if c != name]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(name, kind)])
    arrow = pa.float64() if isinstance(kind, T.DoubleType) else pa.list_(pa.float64())

    def run(batches):
        for b in portions(batches):
            at = b.schema.get_field_index(text)
            out = [of(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array(out, arrow)], names=schema.names)

    return df.mapInArrow(run, schema)


def counts(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    return _over(df, "counts", T.ArrayType(T.DoubleType()), text, model.counts)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with score double."""
    return _over(df, "score", T.DoubleType(), text, model.score)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = held_out(F.col("doc_id"))
    model = learn(docs.where(~held), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    done = score(docs.select("doc_id", "text", held.alias("held_out")), model)
    return done.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
