"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

The lexicon is learned from labelled rows: words, and stems that take many endings, that documents
labelled toxic hold far more often than others. It is kept as a trie, and the Levenshtein automata of
its entries are run over the trie together: a state is the set of (trie node, edits) that a word's
letters so far can reach. States are made on first use and remembered, so a word costs one lookup a
letter. Each match gets a context window: one in quotation marks or near a reporting word counts as
quoted, one near a second-person word as directed. A logistic model over the sums gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import masked, remainder, slices, small_or_shuffled, stored, tokens_of, words_of

THRESHOLD = 0.7
#: Words on either side of a match that its context window holds.
CONTEXT = 4
#: Words and states remembered by one Python worker; beyond them it starts anew. Never changes a result.
WORD_CACHE, MAX_STATES = 100_000, 200_000

# Words that mark a mention of a term, and words that address the reader.
REPORTING = frozenset(b"said says called calls wrote writes quote quoted quotes word words term terms means meaning phrase".split())
ADDRESS = frozenset(b"you your yours youre u ur".split())
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_QUOTES = {"“": "”", "«": "»", "„": "“", "‹": "›"}


@dataclass(frozen=True)
class Entry:
    text: str
    stem: bool
    weight: float

    @property
    def edits(self) -> int:
        """Edits allowed: none for short entries, one from five letters (six for stems), two from nine."""
        n = len(self.text) - self.stem
        return 2 if n >= 9 and not self.stem else 1 if n >= 5 else 0


class LexiconAutomaton:
    """Best (entry number, edits) of a word, or None."""

    def __init__(self, entries: list[Entry]):
        self.entries = entries
        self._children: list[dict[str, int]] = [{}]
        self._ends: list[list[int]] = [[]]
        self._budget: list[int] = [0]
        for k, entry in enumerate(entries):
            node = 0
            for c in entry.text:
                self._budget[node] = max(self._budget[node], entry.edits)
                if c not in self._children[node]:
                    self._children[node][c] = len(self._children)
                    self._children.append({})
                    self._ends.append([])
                    self._budget.append(0)
                node = self._children[node][c]
            self._budget[node] = max(self._budget[node], entry.edits)
            self._ends[node].append(k)
        self._letters = {c for kids in self._children for c in kids}
        self._forget()

    def _forget(self) -> None:
        """Back to the start state alone; the others are made again when they are met."""
        self._number: dict[tuple, int] = {}
        self._states: list[tuple] = []
        self._steps: list[dict[str, int]] = []
        self._start = self._add({0: 0}, {})

    def _add(self, reach: dict[int, int], found: dict[int, int]) -> int:
        """The number of the state of these nodes (with their fewest edits) and stems found."""
        queue = list(reach.items())
        while queue:  # skip letters of the entry
            node, e = queue.pop()
            if reach[node] < e:
                continue
            for child in self._children[node].values():
                if e + 1 <= self._budget[child] and e + 1 < reach.get(child, 99):
                    reach[child] = e + 1
                    queue.append((child, e + 1))
        for node, e in reach.items():
            for k in self._ends[node]:
                if self.entries[k].stem and e <= self.entries[k].edits:
                    found[k] = min(e, found.get(k, 99))
        key = (tuple(sorted(reach.items())), tuple(sorted(found.items())))
        if key not in self._number:
            self._number[key] = len(self._states)
            self._states.append(key)
            self._steps.append({})
        return self._number[key]

    def _step(self, state: int, c: str) -> int:
        reach, found = self._states[state]
        new: dict[int, int] = {}
        for node, e in reach:
            moves = [(child, e + (letter != c)) for letter, child in self._children[node].items()] + [(node, e + 1)]
            for to, edits in moves:
                if edits <= self._budget[to] and edits < new.get(to, 99):
                    new[to] = edits
        return self._add(new, dict(found))

    def match(self, word: str) -> tuple[int, int] | None:
        if len(self._states) > MAX_STATES:
            self._forget()
        state = self._start
        for c in word:
            c = c if c in self._letters else ""
            to = self._steps[state].get(c)
            if to is None:
                to = self._steps[state][c] = self._step(state, c)
            state = to
            if self._states[state] == ((), ()):
                return None
        reach, found = self._states[state]
        best = [(e, k) for k, e in found]
        best += [(e, k) for node, e in reach for k in self._ends[node] if not self.entries[k].stem and e <= self.entries[k].edits]
        return (min(best)[1], min(best)[0]) if best else None


@dataclass
class ToxicityModel:
    entries: list[Entry]
    innocent: frozenset[bytes]
    weights: np.ndarray
    bias: float


class _Matches(dict):
    """Match of a word, or None."""

    def __init__(self, entries: list[Entry], innocent: frozenset[bytes]):
        super().__init__()
        self._automaton, self._innocent = LexiconAutomaton(entries), innocent

    def __missing__(self, word: bytes):
        found = self._automaton.match(word.decode("utf-8", "replace"))
        if found and found[1] and word in self._innocent:
            found = None
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = found
        return found


def _quoted_words(text: str) -> set[int]:
    """Numbers of the words inside quotation marks that close on the same line."""
    inside: set[int] = set()
    n = 0
    for line in text.split("\n"):
        spans, opened, close = [], None, None
        for i, c in enumerate(line):
            if opened is not None and c == close:
                spans.append((opened, i))
                opened = None
            elif opened is None and (c == '"' or c in _QUOTES):
                opened, close = i, _QUOTES.get(c, '"')
        for m in _WORD.finditer(line):
            if any(a < m.start() < b for a, b in spans):
                inside.add(n)
            n += 1
    return inside


FEATURES = ("exact", "stem", "misspelled", "quoted", "directed", "density")


def features(text: str | None, matches: _Matches) -> list[float]:
    """The sums of FEATURES over the matches of a text."""
    words = words_of(text)
    hits = [(i, m) for i, m in enumerate(map(matches.__getitem__, words)) if m]
    if not hits:
        return [0.0] * len(FEATURES)
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    quoted = _quoted_words(lowered)
    sums = dict.fromkeys(FEATURES, 0.0)
    for i, (k, edits) in hits:
        around = {*words[max(0, i - CONTEXT) : i], *words[i + 1 : i + 1 + CONTEXT]}
        if i in quoted or around & REPORTING:
            sums["quoted"] += 1
            continue
        entry = matches._automaton.entries[k]
        sums["misspelled" if edits else "stem" if entry.stem else "exact"] += entry.weight
        sums["directed"] += bool(around & ADDRESS)
        sums["density"] += 1 / len(words)
    return [math.log1p(v) if k != "density" else math.sqrt(v) for k, v in sums.items()]


def _first_shingle(text: str | None) -> int:
    """Smallest hash of five consecutive words; near copies mostly agree."""
    words = tokens_of(text)
    return min((xxhash.xxh3_64_intdigest(b" ".join(words[k : k + 5])) for k in range(max(1, len(words) - 4))), default=0) >> 1


def _terms(text: str | None) -> set[str]:
    """Words of three letters or more, and as `x*` their beginnings of 4 to 10 letters."""
    found: set[str] = set()
    for w in {w.decode("utf-8", "replace") for w in words_of(text)}:
        if len(w) >= 3:
            found.add(w)
            found.update(w[:k] + "*" for k in range(4, min(10, len(w)) + 1))
    return found


def _document_counts(texts: DataFrame, among: frozenset[str] | None) -> DataFrame:
    """(term, n): documents of texts (text) that hold a term, of the given terms only if any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 2_000_000):
            n: Counter = Counter()
            for text in batch.column(0).to_pylist():
                terms = _terms(text)
                n.update(terms if among is None else terms & among)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

    return texts.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def choose_entries(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> list[Entry]:
    """Lexicon entries from document counts of terms among toxic and other documents."""

    def odds(term: str) -> float:
        return math.log((toxic[term] + 0.5) / (n_toxic + 1)) - math.log((clean.get(term, 0) + 0.5) / (n_clean + 1))

    telling = {t for t in toxic if odds(t) >= 2.5}
    entries = []

    def settle(start: str) -> None:
        """Takes the longest beginning that nearly all documents of `start*` share, or its parts."""
        n = toxic[start + "*"]
        longer = sorted((t for t in telling if len(t) == len(start) + 2 and t.startswith(start) and t[-1] == "*"), key=lambda t: (-toxic[t], t))
        if start in telling and toxic[start] >= 0.9 * n:
            entries.append(Entry(start, False, min(1.0, odds(start) / 6)))
        elif longer and toxic[longer[0]] >= 0.9 * n:
            settle(longer[0][:-1])
        elif longer and len(longer) <= 3 and sum(toxic[t] for t in longer) >= 0.9 * n:
            for t in longer:
                settle(t[:-1])
        else:
            entries.append(Entry(start, True, min(1.0, odds(start + "*") / 6)))

    stems = [t for t in telling if t[-1] == "*"]
    for t in sorted(stems):
        if not any(t[:k] + "*" in telling for k in range(4, len(t) - 1)):
            settle(t[:-1])
    held, starts = {e.text for e in entries if not e.stem}, tuple(e.text for e in entries if e.stem)
    for t in sorted(telling.difference(stems)):  # words that no stem or word so far stands for
        if t not in held and not t.startswith(starts):
            entries.append(Entry(t, False, min(1.0, odds(t) / 6)))
    return sorted(set(entries), key=lambda e: (e.text, e.stem))


def _logistic(rows: DataFrame, penalty: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weights (none negative) and bias of a penalised logistic model of rows (x, y, n: how many rows are alike)."""
    assembled = rows.select(array_to_vector("x").alias("x"), F.col("y").cast("double").alias("y"), F.col("n").cast("double").alias("n"))
    total = rows.agg(F.sum("n")).first()[0]
    model = LogisticRegression(
        featuresCol="x", labelCol="y", weightCol="n", regParam=penalty / total, standardization=False, maxIter=200, tol=1e-9,
        lowerBoundsOnCoefficients=DenseMatrix(1, len(FEATURES), [0.0] * len(FEATURES)),
    ).fit(assembled)
    return model.coefficients.toArray(), float(model.intercept)


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learns from all labelled rows whose crc32(doc_id as text) mod 3 is not 1.

    Near copies among them count once for the lexicon. Rows without a 0/1 label, labels of absent
    documents and null ids are not used. Without both labels the model gives the share of label 1
    (0.5 if there is none at all).
    """
    own = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 3) != 1))
    once = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    taught = small_or_shuffled(once)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            first = [_first_shingle(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int64())], names=["text", "_toxic", "_first"])

    texts = stored(docs.select("doc_id", "text").join(taught, "doc_id").select("text", "_toxic").mapInArrow(mark, "text string, _toxic int, _first long"))
    different = stored(texts.dropDuplicates(["_first", "_toxic"]))
    sizes = {r["_toxic"]: r.n for r in different.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        p = 0.5 if n_toxic == n_clean else float(n_toxic > 0)
        return ToxicityModel([], frozenset(), np.zeros(len(FEATURES)), math.log((p + 1e-3) / (1 - p + 1e-3)))
    least = max(3, math.ceil(0.004 * n_toxic))
    toxic = {r.term: r.n for r in _document_counts(different.where("_toxic = 1"), None).where(F.col("n") >= least).collect()}
    clean = {r.term: r.n for r in _document_counts(different.where("_toxic = 0"), frozenset(toxic)).collect()}
    entries = choose_entries(toxic, clean, n_toxic, n_clean)

    def misspelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = _Matches(entries, frozenset())
        for batch in slices(batches, 0):
            found = {w for t in batch.column(0).to_pylist() for w in set(words_of(t)) if (m := matches[w]) and m[1]}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], names=["word"])

    innocent = frozenset(bytes(r.word) for r in different.where("_toxic = 0").select("text").mapInArrow(misspelled, "word binary").distinct().collect())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = _Matches(entries, innocent)
        for batch in slices(batches, 0):
            x = [features(t, matches) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = texts.select("text", "_toxic").mapInArrow(measure, "x array<double>, y int")
    weights, bias = _logistic(stored(rows.groupBy("x", "y").agg(F.count("*").alias("n"))))
    return ToxicityModel(entries, innocent, weights, bias)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", into: str = "toxicity") -> DataFrame:
    """docs, all columns, plus the score (0 to 1) of the column text alone; null counts as empty."""
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])
    names = schema.names

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = _Matches(model.entries, model.innocent)
        for batch in slices(batches, at):
            x = np.array([features(t, matches) for t in batch.column(at).to_pylist()], float).reshape(-1, len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(x @ model.weights + model.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=names)

    return docs.mapInArrow(add, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null and empty texts get the score of a text without any match; repeated rows are scored alike; long texts are
    read whole; other columns of docs are never read; an empty table gives an empty one.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels), into="score")
    held_out = (remainder(F.col("doc_id"), 3) == 1).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns whatever their names, without the rows whose toxicity reaches the threshold."""
    own, place, back = masked(docs)
    return back(score(own, fit(docs, labels), place["text"]).where(F.col("toxicity") < threshold))
