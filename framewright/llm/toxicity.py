"""Toxicity by class-conditional Kneser-Ney models.

Two models give each word of a text a likelihood, one from the toxic and one from the
ordinary labelled texts. Each discounts its class's own counts of a word and hands what
that frees to one letter model of words, whose orders count distinct preceding letters
over both classes together: a word that is rare in a class gets the same backoff from
either. Words that were seen once keep their counts. A text's score compares the two
log-likelihoods per word over the whole text.

Counts, letter orders and ratios are tables made by aggregates and joins, over all
labelled rows. A word of which the models say less than NOISE says nothing, so only the
telling words are needed to score; up to MODEL_WORDS of them are sent to the workers,
more of them are joined.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, slices

#: The bound of the calibration: held-back rows of each class that are measured, those with the smallest hashes of their doc_id. Counts come from all rows.
TRAIN_ROWS = 4_000
#: Letters the backoff looks at, the predicted one included.
ORDER = 5
DISCOUNT = 0.75
#: A word's log ratio counts from NOISE on, up to CLIP, so that neither many indifferent words nor a single one decide.
NOISE, CLIP = 3.0, 10.0
#: The share of a letter that the letter model has never seen.
LETTER = 1 / 65_536
#: Telling words that are sent to workers, of at most 64 letters each.
MODEL_WORDS = 1_000_000
#: Labels that are sent to the workers, where more would be joined by an exchange of the texts.
LABELS = 2_000_000
#: Marks around a word, and the different words that a task counts before it sends them.
OPEN, CLOSE, COUNTED = "\x02", "\x03", 200_000

#: Runs of letters and digits, and runs of signs, of the lower-case text; longer ones in pieces.
find_words = re.compile(r"\w{1,64}|[^\w\s]{1,64}").findall


def word_counts(labelled: DataFrame) -> DataFrame:
    """word and its counts n00, n01, n10, n11, by fold and class, over labelled texts; each task sends what it has counted."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            keys, n = zip(*counts.items())
            word, fold, toxic = zip(*keys)
            return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(fold, pa.int32()), pa.array(toxic, pa.int32()), pa.array(n, pa.int64())], names=["word", "fold", "toxic", "n"])

        for batch in slices(batches):
            for text, fold, toxic in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for word, n in Counter(find_words(text.lower())).items():
                    counts[word, fold, toxic] += n
                if len(counts) > COUNTED:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    sent = labelled.select("text", "fold", "toxic").mapInArrow(run, "word string, fold int, toxic int, n long")
    each = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == c), F.col("n")).otherwise(0)).cast("long").alias(f"n{f}{c}") for f in (0, 1) for c in (0, 1)]
    return sent.groupBy("word").agg(*each)


def letter_backoff(vocabulary: DataFrame) -> DataFrame:
    """word and backoff, its log-likelihood under a Kneser-Ney letter model of the vocabulary's words.

    The highest order counts words, each lower one the distinct letters before an n-gram.
    """
    padded = F.concat(F.lit(OPEN * (ORDER - 1)), "word", F.lit(CLOSE))
    each = F.transform(F.sequence(F.lit(1), F.char_length("word") + 1), lambda k: F.substring(padded, k, F.lit(ORDER)))
    grams = vocabulary.select("word", F.explode(each).alias("gram"))
    levels = [cut(grams.groupBy("gram").agg(F.count("*").alias("n")))]
    for n in range(ORDER - 1, 0, -1):
        shorter = levels[0].groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("n"))
        levels.insert(0, cut(shorter))
    found = None
    for n, level in enumerate(levels, 1):
        level = level.withColumn("context", F.substring("gram", 1, n - 1))
        of = level.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        rows = level.join(of, "context")
        if found is None:
            rows = rows.withColumn("below", F.lit(LETTER))
        else:
            rows = rows.withColumn("rest", F.substring("gram", 2, n - 1)).join(found.select(F.col("gram").alias("rest"), F.col("p").alias("below")), "rest")
        found = rows.select("gram", ((F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("below")) / F.col("total")).alias("p"))
    return grams.join(found, "gram").groupBy("word").agg(F.sum(F.log("p")).alias("backoff"))


def word_ratios(counts: DataFrame) -> DataFrame:
    """word and ratio, the log of its likelihood among toxic over that among ordinary words, of word, n0, n1 and backoff."""
    told = counts.agg(*(x for c in (0, 1) for x in (F.sum(f"n{c}").alias(f"total{c}"), F.count_if(F.col(f"n{c}") > 0).alias(f"kinds{c}")))).first()

    def likelihood(c: int):
        total, kinds = told[f"total{c}"], told[f"kinds{c}"]
        own = F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / float(total)
        return own + DISCOUNT * kinds / total * F.exp(F.greatest("backoff", F.lit(-600.0)))

    return counts.select("word", (F.log(likelihood(1)) - F.log(likelihood(0))).alias("ratio"))


def telling_words(counts: DataFrame) -> DataFrame:
    """word and excess: how far its ratio goes beyond NOISE, up to CLIP, where it does."""
    return word_ratios(counts).where(F.col("ratio") > NOISE).select("word", (F.least("ratio", F.lit(CLIP)) - NOISE).alias("excess"))


class Evidence:
    """The telling words: sent to the workers up to a bound, else a table that is joined."""

    def __init__(self, words: DataFrame, most: int = MODEL_WORDS):
        self.words, self.sent = cut(words), None
        if self.words.limit(most + 1).count() <= most:
            found = self.words.toArrow()
            self.sent = words.sparkSession.sparkContext.broadcast(dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist())))

    def measure(self, rows: DataFrame, name: str) -> DataFrame:
        """rows with a column: the toxic log-likelihood beyond the ordinary one, NOISE taken from each word, per word of the whole text."""
        schema = StructType([*rows.schema.fields, StructField(name, DoubleType())])
        if self.sent is None:
            return self._joined(rows, name)
        sent = self.sent

        def run(batches):
            excess = sent.value
            for batch in slices(batches):
                x = []
                for text in batch.column("text").to_pylist():
                    words = find_words((text or "").lower())
                    x.append(sum([excess[w] for w in words if w in excess]) / max(1, len(words)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.float64())], names=schema.names)

        return rows.mapInArrow(run, schema)

    def _joined(self, rows: DataFrame, name: str) -> DataFrame:
        """The same by a join on words: different texts count theirs once, and only words that tell meet their excess."""

        def run(batches):
            for batch in slices(batches, 200):
                for text in batch.column(0).to_pylist():
                    words = Counter(find_words(text.lower()))
                    key = pa.array([text] * 1).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([key, pa.array([sum(words.values())], pa.int64()), pa.array([list(words.items())], pa.map_(pa.string(), pa.int64()))], names=["text", "size", "words"])

        texts = rows.where("text IS NOT NULL").select("text").distinct()
        counted = texts.mapInArrow(run, "text string, size long, words map<string,long>").select(F.sha2("text", 256).alias("__of"), "size", F.explode("words").alias("word", "n"))
        found = counted.join(self.words, "word").groupBy("__of").agg((F.sum(F.col("n") * F.col("excess")) / F.first("size")).alias("__x"))
        keyed = rows.withColumn("__is", F.sha2(F.coalesce("text", F.lit("")), 256))
        return keyed.join(found, F.col("__is") == F.col("__of"), "left").select(*rows.columns, F.coalesce("__x", F.lit(0.0)).alias(name))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and constant of the chance of y, by Newton steps; the slope is not negative."""
    mean, scale = x.mean(), x.std() + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + ridge * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    slope = max(0.0, w[0]) / scale
    return float(slope), float(w[1] - slope * mean)


class Model:
    """The evidence, or none, and the line that makes a score of it."""

    def __init__(self, evidence: Evidence | None, line: tuple[float, float]):
        self.evidence, self.line = evidence, line


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, most: int = MODEL_WORDS) -> Model:
    """Fit on all labelled documents, held-out ones (crc32(doc_id) mod 5 = 0) never.

    Three quarters of them make the models from which at most train_rows of the rest, of each class,
    teach the line that calibrates, so that it sees texts as new as those to come. Both classes have the
    same weight there: 0.5 is where a text is as likely from toxic as from ordinary ones. The evidence returned
    is then made from all of them. Rows without a label, a doc_id or a text are
    no examples. With one class or none, nothing is toxic.
    """
    key = F.crc32(F.col("doc_id").cast("string"))
    usable = cut(labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(key % 5 != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    sent = F.broadcast(usable) if usable.limit(LABELS + 1).count() <= LABELS else usable
    fold = (key % 5 == 4).cast("int")
    texts = documents.where("text IS NOT NULL").select("doc_id", "text")
    counts = cut(word_counts(texts.join(sent, "doc_id").select("text", fold.alias("fold"), "toxic")))
    has = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n00", "n01", "n10", "n11"))).first()
    if not (has.n00 + has.n10) or not (has.n01 + has.n11):
        return Model(None, (0.0, -10.0))
    known = cut(counts.join(letter_backoff(counts.select("word")), "word"))
    line = (1.0, -0.5)
    if has.n00 and has.n01 and has.n10 and has.n11:
        part = Evidence(telling_words(known.select("word", F.col("n00").alias("n0"), F.col("n01").alias("n1"), "backoff").where("n0 + n1 > 0")), most)
        take = lambda c: usable.where((F.col("toxic") == c) & (fold == 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
        held = part.measure(texts.join(F.broadcast(take(0).union(take(1))), "doc_id").select("text", "toxic"), "x").select("x", "toxic").toPandas()
        y = held.toxic.to_numpy(dtype=float)
        if 0 < y.sum() < len(y):
            line = fit_logistic(held.x.to_numpy(), y, np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y))
    whole = Evidence(telling_words(known.select("word", (F.col("n00") + F.col("n10")).alias("n0"), (F.col("n01") + F.col("n11")).alias("n1"), "backoff")), most)
    return Model(whole, line)


def score(documents: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """The documents with a score, 0 to 1, under a name that replaces a column so named; a null text counts as empty, an empty one has the score of no evidence."""
    slope, constant = model.line
    kept = documents.drop(name)
    measured = model.evidence.measure(kept, name) if model.evidence else kept.withColumn(name, F.lit(0.0))
    return measured.withColumn(name, 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), slope * F.col(name) + constant)))))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted; a row per input row, repeated rows and null ids too."""
    scored = score(documents.select("doc_id", "text"), fit(documents, labels))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
