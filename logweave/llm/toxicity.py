"""Toxicity score from a weighted lexicon matched by Aho-Corasick.

Text is folded first: compatibility forms and case, characters that look like
Latin letters (Cyrillic, Greek), digits and signs that stand for letters inside
a word that has letters; i, l, 1 and | become one letter. What is left of a text
is its words, one blank between two.

Entries of the lexicon are whole words or open stems (a word's first letters,
with more to follow), so a whole word that is harmless does not speak for its
longer forms. They are learned from labelled rows: for each entry the number of
toxic and of clean documents that hold it gives a weight (log of the smoothed
rates' ratio); an entry must be informative (G squared of at least ``MIN_G2``),
weigh ``MIN_WEIGHT`` or more and come from ``MIN_DOCS`` toxic documents. Entries that are another's
beginning give way to the more informative one. Exception phrases (a word under
a stem, or two words with a hit in them) that speak for clean documents cancel
the hits inside them.

All entries and exceptions stand in one Aho-Corasick automaton that runs over
the whole folded text. A text's hits are summed by weight and divided by the
square root of its number of words; the root of that goes through a logistic
curve fitted on the same rows: the score.

Labels are read only from rows that ``held_out`` leaves to learning; where there
are more than ``SAMPLE_DOCS`` of these, a sample of about that many by a hash of
the id is used (a bound on the fit alone; all texts are scored). Labels,
language, source and id are no inputs of a score. The model (``ENTRIES`` entries
and as many exceptions at most) is the only thing that passes through the driver.

Defined results: null and empty texts have no words and get the score of no
hits; a null id is not held out and has no label; rows that share an id share
its label (1 if any of its label rows says so), a null label is none; without
labels the lexicon is empty and every score is the same; an empty table gives
an empty result. Extra columns are carried along, and an input column named
like an output column gives way.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import col, packed, stored, text_of, unpacked

SAMPLE_DOCS = 20_000
ENTRIES = 5_000
MIN_DOCS = 4
MIN_G2 = 24.0
MIN_WEIGHT = 2.0
MIN_CLEAN = 3
STEM = (4, 12)
CUT = 0.3
OWN = ("held_out", "score", "predicted", "n_hits", "hits")

# characters that look like Latin letters, side by side with them
LOOKS = dict(zip("авекмнорстухіјѕԁһԛԝαβεικνορτυχγ", "abekmhopctyxijsdhqwabeikvoptuxy", strict=True))
# digits and signs that stand for letters inside a word
DIGITS = dict(zip("013456789@$|", "oieasgtbgasi", strict=True))
ONE_LETTER = {"l": "i"}
FOLD = str.maketrans(LOOKS | ONE_LETTER)
DIGIT = str.maketrans(DIGITS)
MIXED = re.compile(r"[\w@$|]*[^\W\d_][@$|\d]+[\w@$|]*|[\w@$|]*[@$|\d][^\W\d_][\w@$|]*")
HAS_DIGIT = re.compile(r"[\d@$|]")
BREAK = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """The words of a text, folded, with a blank before, between and after."""
    text = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()
    if HAS_DIGIT.search(text):
        text = MIXED.sub(lambda m: m.group().strip("@$|").translate(DIGIT), text)
    return f" {BREAK.sub(' ', text.translate(FOLD)).strip()} "


def words_in(folded: str) -> int:
    return folded.count(" ") - 1 if folded.strip() else 0


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


# --- the lexicon ---------------------------------------------------------------

class Lexicon:
    """Weighted entries and exceptions in one automaton. An entry ending in a
    blank is a whole word, any other an open stem."""

    def __init__(self, weights: dict[str, float], exceptions: set[str] = frozenset(), curve: tuple = (0.0, 0.0)):
        import ahocorasick

        self.weights, self.exceptions, self.curve = weights, set(exceptions), curve
        self.machine = ahocorasick.Automaton()
        for entry, w in weights.items():
            self.machine.add_word(" " + entry, (len(entry) + 1, w))
        for phrase in self.exceptions:
            self.machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(self.machine):
            self.machine.make_automaton()

    def __getstate__(self):
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state):
        self.__init__(*state)

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(place of the word, weight) of the words with an entry, the longest
        entry of each, without those inside an exception."""
        if not len(self.machine):
            return []
        found, spans = {}, []
        for end, (size, w) in self.machine.iter(folded):
            start = end - size + 1
            if w is None:
                spans.append((start, end))
            elif folded[end] == " " or folded[end + 1] != " ":
                found[start] = w  # longer entries end later
        for start, end in spans:
            for at in [at for at in found if start <= at < end]:
                del found[at]
        return sorted(found.items())

    def strength(self, folded: str) -> float:
        n = words_in(folded)
        return math.sqrt(sum(w for _, w in self.hits(folded)) / math.sqrt(n)) if n else 0.0

    def score(self, folded: str) -> float:
        a, b = self.curve
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a * self.strength(folded) + b))))


def features(folded: str) -> set[str]:
    """Whole words (with a blank) and open stems of a folded text."""
    out = set()
    for w in set(folded.split()):
        out.add(w + " ")
        out.update(w[:k] for k in range(STEM[0], min(len(w) - 1, STEM[1]) + 1))
    return out


def phrases(folded: str, lexicon: Lexicon) -> set[str]:
    """Hit words, and pairs of words with a hit, of a folded text."""
    out = set()
    for at, _ in lexicon.hits(folded):
        end = folded.index(" ", at + 1)
        word = folded[at + 1:end]
        before, after = folded[:at].rpartition(" ")[2], folded[end + 1:].partition(" ")[0]
        out.add(word)
        out |= {f"{before} {word}"} if before else set()
        out |= {f"{word} {after}"} if after else set()
    return out


# --- learning ------------------------------------------------------------------

def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str,
                  sample: int = SAMPLE_DOCS) -> DataFrame:
    """(toxic, folded text) of the labelled documents that may be learned from."""
    marks = (labels.select(col(id_col).cast("long").alias("_id"), col(label_col).cast("int").alias("toxic"))
             .filter("_id is not null and toxic is not null").groupBy("_id").agg(F.max("toxic").alias("toxic")))
    marks = marks.filter(~held_out("_id"))
    total = marks.count()
    if total > sample:
        # a hash of the id decides, so the sample stays the same and is spread over all rows
        marks = marks.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    texts = docs.select(col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic"), pa.array([fold(t) for t in b.column("_t").to_pylist()], pa.string())],
                names=["toxic", "_f"])
    # at most SAMPLE_DOCS ids: they go to the texts
    return texts.join(F.broadcast(marks), "_id").select("toxic", "_t").mapInArrow(run, "toxic int, _f string")


def _counted(rows: DataFrame, of) -> DataFrame:
    """(f, a, b): documents with feature f, toxic and clean."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = Counter(), Counter()
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("_f").to_pylist(), strict=True):
                (a if toxic else b).update(of(text))
            keys = list(a.keys() | b.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (a, b))],
                names=["f", "a", "b"])
    return rows.mapInArrow(run, "f string, a bigint, b bigint").groupBy("f").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"))


def g_squared(a: Column, b: Column, toxic: int, clean: int) -> Column:
    """Log-likelihood ratio of an entry's presence against the label."""
    n = float(toxic + clean)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    held = a + b
    return 2 * (part(a, held * (toxic / n)) + part(b, held * (clean / n))
                + part(toxic - a, (n - held) * (toxic / n)) + part(clean - b, (n - held) * (clean / n)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5) -> tuple[float, float]:
    """(slope, offset) of a logistic curve, by Newton steps on a small ridge."""
    design, theta = np.stack([x, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        grad = design.T @ (p - y) + ridge * len(x) * theta * [1, 0]
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([ridge * len(x), 1e-9])
        step = np.linalg.solve(hess, grad)
        theta = theta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: int = SAMPLE_DOCS) -> Lexicon:
    """The lexicon of the labelled rows that may be learned from."""
    rows = stored(training_rows(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample),
                  "folded")
    sizes = {r["toxic"] > 0: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return Lexicon({}, curve=(0.0, math.log((toxic + 1) / (clean + 1))))
    counts = _counted(rows, features).filter(
        (F.col("a") >= MIN_DOCS) & (F.col("a") * clean > F.col("b") * toxic))
    best = (counts.withColumn("g", g_squared(F.col("a"), F.col("b"), toxic, clean)).filter(F.col("g") >= MIN_G2)
            .orderBy(F.desc("g"), F.desc(F.length("f")), "f").limit(ENTRIES).collect())
    weights: dict[str, float] = {}
    stems: set[str] = set()  # beginnings of the entries taken
    taken: set[str] = set()
    for r in best:
        word = r["f"].strip()
        if word in stems or any(word[:k] in taken for k in range(1, len(word) + 1)):
            continue
        weight = math.log((r["a"] + 0.5) / (toxic + 1) * (clean + 1) / (r["b"] + 0.5))
        if weight < MIN_WEIGHT:
            continue
        taken.add(word)
        stems.update(word[:k] for k in range(1, len(word) + 1))
        weights[r["f"]] = weight
    lexicon = Lexicon(weights)
    harmless = (_counted(rows, lambda text: phrases(text, lexicon))
                .filter((F.col("b") >= MIN_CLEAN) & (F.col("b") * toxic >= F.col("a") * clean))
                .orderBy(F.desc("b"), "f").limit(ENTRIES).collect())
    lexicon = Lexicon(weights, {r["f"] for r in harmless})

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic"), pa.array([lexicon.strength(t) for t in b.column("_f").to_pylist()], pa.float64())],
                names=["toxic", "x"])
    points = rows.mapInArrow(strengths, "toxic int, x double").collect()  # one point for each row of the sample
    points.sort()
    x, y = np.array([r["x"] for r in points]), np.array([r["toxic"] > 0 for r in points], float)
    return Lexicon(weights, lexicon.exceptions, logistic(x, y))


# --- scoring -------------------------------------------------------------------

def score_texts(docs: DataFrame, lexicon: Lexicon, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns in ``carry``) with score, n_hits and the hit
    words (folded, in order of place)."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in OWN]
    kept = docs.select(*[col(c) for c in carry])
    rows = docs.select((packed(kept) if carry else F.struct(F.lit(0).alias("x")).alias("_row")),
                       text_of(text_col).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, hits = [], []
            for text in batch.column("_t").to_pylist():
                folded = fold(text)
                scores.append(lexicon.score(folded))
                hits.append([folded[at + 1:folded.index(" ", at + 1)] for at, _ in lexicon.hits(folded)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(scores, pa.float64()), pa.array(hits, pa.list_(pa.string()))],
                names=["_row", "score", "hits"])
    kind = rows.schema["_row"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"_row {kind}, score double, hits array<string>")
    return scored.select(*unpacked(carry), "score", F.size("hits").cast("long").alias("n_hits"), "hits")


def q_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    scored = score_texts(docs, learn(docs, labels.select("doc_id", "toxic")), carry=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
