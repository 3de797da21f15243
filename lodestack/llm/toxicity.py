"""Toxicity by two Kneser-Ney models of the letters in words, one for each class, that share their backoff counts.

Every letter of a text counts, by both classes' likelihoods."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestack.llm.common import Memory, as_documents, freeing, mix, text_slices, with_label, worker_cache, written

#: Letters that a letter is predicted from; those of the same word only.
CONTEXT = 4

#: Kneser-Ney's absolute discount.
DISCOUNT = 0.75

#: For a table of what tells the classes apart alone (``train`` without ``every``): a letter in its context has counts of each class where these differ beyond chance (a G statistic of this much) and its likelihoods do by this log
#: ratio; elsewhere, and where it is in fewer than LEAST_COUNT documents of each class, the classes share their counts and have one likelihood.
LEAST_G, LEAST_RATIO, LEAST_COUNT = 15.0, 1.0, 3

#: Likelihood of a letter that was never met, in the last backoff: one of so many.
ALPHABET = 64

#: A model of up to so many rows (16 bytes each) is sent to the tasks; a larger one is joined by key.
MOST_SENT_ROWS = 2_000_000

#: The two numbers that turn a length-normalised log-likelihood ratio into a score are fitted on at most about so many labelled rows left out of the counts.
MOST_CALIBRATION_ROWS = 20_000

_BETWEEN_WORDS = re.compile(r"[\W\d_]+")


def letters(text: str) -> tuple[list[np.ndarray], np.ndarray, int]:
    """Hashes of the up to CONTEXT, CONTEXT - 1, ..., 1 letters before each letter (and each word's end) in its word; the letters; and the
    number of words. Case, digits and punctuation don't count."""
    code = np.frombuffer(f" {_BETWEEN_WORDS.sub(' ', text.lower()).strip()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(code) <= 2:
        return [code[:0]] * CONTEXT, code[:0], 0
    space = code == 32
    at = np.arange(len(code))
    inside = at - np.maximum.accumulate(np.where(space, at, 0))  # letters since the word's start; of a word's end those of the word
    inside[1:] = np.where(space[1:], inside[:-1] + 1, inside[1:])
    value, contexts = np.full(len(code), 1, np.uint64), []
    for k in range(1, CONTEXT + 1):
        before = np.zeros(len(code), np.uint64)
        before[k:] = np.where(inside[k:] > k, code[:-k], 0)
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + before)
        contexts.append((value >> np.uint64(23))[1:])
    return contexts[::-1], code[1:], int(space.sum()) - 1


def _keys(context: np.ndarray, letter: np.ndarray) -> np.ndarray:
    return ((context << np.uint64(21)) | letter).astype(np.int64)


#: Through how many shorter contexts the shared backoff of a table of what tells the classes apart goes; that of the models goes through all CONTEXT.
BACKOFFS = 1

#: Bytes of words that a worker remembers the ratios of.
WORD_BYTES = 24 << 20


def _shorter(backoffs: int) -> list[str]:
    """The columns of so many shorter contexts, the longest first; that of no letter needs none."""
    return [f"h{CONTEXT - k}" for k in range(1, min(backoffs, CONTEXT - 1) + 1)]


def held_out(doc_id: Column) -> Column:
    """True for the rows that no label may be learnt from; a null id is not held out and has no label."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def letter_counts(documents: DataFrame, label: str, backoffs: int = BACKOFFS) -> DataFrame:
    """In how many toxic and ordinary documents each letter follows each context: key, context, its shorter contexts, letter, t, o.

    A document counts once for an expression, so that its repetitions don't. Tasks add up their documents before the shuffle.
    """
    shorter_contexts = _shorter(backoffs)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("letters", dict)  # lets go of what other operators have kept
        for piece, texts in text_slices(batches, "text", 1 << 18):
            found: list[tuple] = []
            for text, toxic in zip(texts, piece.column(label).to_pylist()):
                contexts, letter, _ = letters(text or "")
                if len(letter):
                    key, first = np.unique(_keys(contexts[0], letter), return_index=True)
                    found.append((key, np.full(len(key), toxic == 1), *[c[first].astype(np.int64) for c in contexts[1 : 1 + len(shorter_contexts)]]))
            if found:
                key, toxic, *shorter = (np.concatenate(x) for x in zip(*found))
                own, first, at = np.unique(key, return_index=True, return_inverse=True)
                t = np.bincount(at, weights=toxic, minlength=len(own)).astype(np.int64)
                o = np.bincount(at, minlength=len(own)) - t
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own, *[h[first] for h in shorter], t, o)], ["key", *shorter_contexts, "t", "o"])

    schema = ", ".join(f"{c} long" for c in ("key", *shorter_contexts, "t", "o"))
    found = documents.select("text", label).mapInArrow(freeing(counted), schema).groupBy("key", *shorter_contexts).agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    return found.select("key", F.shiftright("key", 21).alias("context"), *shorter_contexts, F.col("key").bitwiseAND((1 << 21) - 1).alias("letter"), "t", "o")


class Model:
    """Log-likelihood ratios of the two classes: what each letter in its context, and each context, adds."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def _at(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0.0)

    def of_words(self, words: list[str]) -> list[float]:
        """The log-likelihood ratio of each word (lower-case letters alone)."""
        if not words or not len(self.keys):
            return [0.0] * len(words)
        contexts, letter, _ = letters(" ".join(words))
        each = self._at(_keys(contexts[0], letter)) + self._at(_keys(contexts[0], np.zeros_like(letter)))
        starts = np.flatnonzero(np.r_[True, letter[:-1] == 32])
        return np.add.reduceat(each, starts).tolist()

    def ratios(self, texts: list[str | None], known: Memory) -> list[float]:
        """The log-likelihood ratio of each text per word; 0 for none. ``known``: that of words met before, as no letter's context leaves its word."""
        split = [_BETWEEN_WORDS.sub(" ", t.lower()).split() if t else [] for t in texts]
        every = set().union(*split)
        new = list(every.difference(known))
        found = dict(zip(new, self.of_words(new)))
        own = {w: found[w] if w in found else known[w] for w in every}
        out = [sum(map(own.__getitem__, words)) / len(words) if words else 0.0 for words in split]
        known.keep(found, len(every))
        return out


def _shared_likelihood(rows: DataFrame, counts: DataFrame, discount: float, backoffs: int = BACKOFFS) -> DataFrame:
    """``rows`` with the column shared: the likelihood of the letter after its shorter contexts, of both classes together.

    Kneser-Ney's recursion over continuation counts: with N(h x), after how many different contexts of one letter more than h the letter x was met,
    S(x | h) = max(N(h x) - d, 0) / N(h .) + d kinds(h) / N(h .) S(x | h without its farthest letter), through so many contexts (the CONTEXT-th is that of no letter), and then 1 / ALPHABET.
    """
    d, levels = F.lit(discount), _shorter(backoffs)
    met = counts.groupBy(*levels, "letter").agg(F.count("*").alias("met"))
    terms = []
    for k, h in enumerate(levels):
        key = [h]
        whole = met.groupBy(*key).agg(F.sum("met").alias(f"all{k}"), F.count("*").alias(f"kinds{k}"))
        own = met.select(*key, "letter", F.col("met").alias(f"met{k}"))
        rows = rows.join(own, [*key, "letter"], "left")
        rows = rows.join(whole, key, "left")
        found = F.col(f"all{k}") > 0
        terms.append((F.when(found, F.greatest(F.coalesce(f"met{k}", F.lit(0)) - d, F.lit(0.0)) / F.col(f"all{k}")).otherwise(0.0), F.when(found, d * F.col(f"kinds{k}") / F.col(f"all{k}")).otherwise(1.0)))
        if levels[k + 1 :]:
            met = met.groupBy(*levels[k + 1 :], "letter").agg(F.count("*").alias("met"))
    shared = F.lit(1.0 / ALPHABET)
    if backoffs >= CONTEXT:
        met = written(met.groupBy("letter").agg(F.count("*").alias("met_alone")))
        every, kinds = [x or 1 for x in met.agg(F.sum("met_alone"), F.count("*")).first()]
        rows = rows.join(F.broadcast(met), "letter", "left")  # a row for each letter of any script
        shared = F.greatest(F.coalesce("met_alone", F.lit(0)) - d, F.lit(0.0)) / every + d * kinds / every * shared
    for own, weight in reversed(terms):
        shared = own + weight * shared
    return rows.withColumn("shared", shared)


def train(documents: DataFrame, label: str, *, discount: float = DISCOUNT, every: bool = False) -> DataFrame:
    """The two models of all of ``documents`` (text, label), a table that grows with them: key, ratio (log likelihood toxic - ordinary).

    ``every``: the models whole. For class c, letter x and context h: P_c(x | h) = max(C_c(h x) - d, 0) / C_c(h) + g_c(h) S(x | h'), where
    g_c(h) = d N_c(h) / C_c(h) of the class's own counts (so each P_c sums to 1), h' is the context without its farthest letter, and S is shared by the
    classes (``_shared_likelihood``, through all shorter contexts). A class that never has the context scores the letter by S alone. A context has a
    row, under letter 0, with the ratio of the letters never met in it, log g_t - log g_o; a letter met in it has one with what its
    own ratio adds. In contexts that neither class has, both take S: no row and a ratio of 0.

    Else a table of what tells the classes apart alone: g is of the counts of both, through BACKOFFS contexts, and where the classes' counts don't
    differ beyond chance, or the expression is rare, both take the counts of both: one likelihood, so no row and a ratio of 0.
    """
    if every:
        return _whole_models(written(letter_counts(documents, label, CONTEXT)), discount)
    counts = written(letter_counts(documents, label))
    nt, no = [float(x or 0) for x in counts.agg(F.sum("t"), F.sum("o")).first()]
    d = F.lit(discount)
    contexts = counts.groupBy("context").agg(F.sum("t").alias("ct"), F.sum("o").alias("co"), F.count("*").alias("kinds"))
    often = (F.col("t") >= LEAST_COUNT) | (F.col("o") >= LEAST_COUNT)
    both = counts.where(often).join(contexts, "context")
    g = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * (F.col("ct") + F.col("co")) / ((F.col("t") + F.col("o")) * F.col(n)))).otherwise(0.0)
    one = [math.log((nt + no) / n) if n else 0.0 for n in (nt, no)]  # what a document says that has a context of its class only
    chance = F.when(F.col("co") == 0, F.col("t") * one[0]).when(F.col("ct") == 0, F.col("o") * one[1]).otherwise(g("t", "ct") + g("o", "co"))
    apart = written(both.where(2 * chance >= LEAST_G))
    apart = _shared_likelihood(apart, counts, discount).withColumn("backoff", d * F.col("kinds") / (F.col("ct") + F.col("co")) * F.col("shared"))
    p = lambda c, n: F.when(F.col(n) > 0, F.greatest(F.col(c) - d, F.lit(0.0)) / F.col(n) + F.col("backoff")).otherwise(F.col("shared"))
    ratio = F.log(p("t", "ct")) - F.log(p("o", "co"))
    return written(apart.select("key", ratio.alias("ratio")).where(F.abs("ratio") >= LEAST_RATIO))


def _whole_models(counts: DataFrame, discount: float) -> DataFrame:
    d = F.lit(discount)
    contexts = counts.groupBy("context").agg(*[f for c in "to" for f in (F.sum(c).alias(f"c{c}"), F.count_if(F.col(c) > 0).alias(f"k{c}"))])
    contexts = written(contexts)
    g = lambda c: F.when(F.col(f"c{c}") > 0, d * F.col(f"k{c}") / F.col(f"c{c}")).otherwise(1.0)
    new = F.log(g("t")) - F.log(g("o"))
    p = lambda c: F.when(F.col(f"c{c}") > 0, F.greatest(F.col(c) - d, F.lit(0.0)) / F.col(f"c{c}")).otherwise(0.0) + g(c) * F.col("shared")
    met = _shared_likelihood(counts.join(contexts, "context"), counts, discount, CONTEXT)
    met = met.select("key", (F.log(p("t")) - F.log(p("o")) - new).alias("ratio"))
    return written(met.unionByName(contexts.select(F.shiftleft("context", 21).alias("key"), new.alias("ratio"))))


def with_ratio(df: DataFrame, model: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the column __ratio: the log-likelihood ratio of its text per word. Up to MOST_SENT_ROWS the model is sent to the tasks that read the
    texts; a larger one is joined to the texts' expressions by key, and equal texts are summed together and divided by their number."""
    if model.limit(MOST_SENT_ROWS + 1).count() <= MOST_SENT_ROWS:
        found = model.toArrow()
        shared = df.sparkSession.sparkContext.broadcast(Model(found.column("key").to_numpy(), found.column("ratio").to_numpy()))
        name = f"ratios {uuid.uuid4()}"

        def ratios(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = worker_cache(name, lambda: Memory(WORD_BYTES))
            for piece, texts in text_slices(batches, text_col, 1 << 18):
                found = pa.array(shared.value.ratios(texts, known), pa.float64())
                yield pa.RecordBatch.from_arrays([*piece.columns, found], [*piece.schema.names, "__ratio"])

        return df.mapInArrow(freeing(ratios), StructType([*df.schema.fields, StructField("__ratio", DoubleType())]))

    def expressions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches, "text", 1 << 18):
            for copy, text in zip(piece.column("__copy").to_pylist(), texts):
                contexts, letter, words = letters(text or "")
                if words:
                    own = _keys(contexts[0], letter), _keys(contexts[0], np.zeros_like(letter))  # the letters, and their contexts
                    key, times = np.unique(np.concatenate(own), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), copy)), pa.array(key), pa.array(times / words)], ["__copy", "key", "share"])

    rows = df.withColumn("__copy", F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    own = rows.select("__copy", F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(freeing(expressions), "__copy long, key long, share double")
    sums = own.join(model, "key").groupBy("__copy").agg(F.sum(F.col("share") * F.col("ratio")).alias("__sum"))
    each = rows.groupBy("__copy").agg(F.count("*").alias("__rows")).join(sums, "__copy").select("__copy", (F.col("__sum") / F.col("__rows")).alias("__ratio"))
    return rows.join(each, "__copy", "left").select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("__ratio", F.lit(0.0)).alias("__ratio"))


def _fitted(ratio: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and intercept of a logistic curve, by Newton's method with a light ridge."""
    if not len(ratio) or label.min() == label.max():
        return 0.0, -2.0 if not len(ratio) or not label.max() else 2.0
    scale = ratio.std() or 1.0
    x, beta = np.c_[ratio / scale, np.ones(len(ratio))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (label - p) - 1e-3 * beta
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), slope)
        beta += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return max(0.0, float(beta[0] / scale)), float(beta[1])


class Judge:
    """Scores texts: a trained model, and the logistic curve that makes a probability of its ratio."""

    def __init__(self, model: DataFrame, slope: float, start: float) -> None:
        self.model, self.slope, self.start = model, slope, start

    def scored(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """``df`` with the column __score."""
        return with_ratio(df, self.model, text_col).withColumn("__score", 1 / (1 + F.exp(-(F.col("__ratio") * self.slope + self.start)))).drop("__ratio")


def fit(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", label_id: str = "doc_id") -> Judge:
    """Learn from the labelled rows of ``df`` that ``held_out`` leaves in; copies of a text count once.

    Four fifths of them are counted into the two models; the others (a bounded number, in the order of a hash) calibrate the score, so it isn't
    fitted to what the counts have seen. Without labels of both classes every score is low (or high, if only toxic labels are known).
    """
    rows = as_documents(df, id_col, text_col)
    own = labels.select(F.col(f"`{label_id}`").alias("__id"), F.col(f"`{label}`").alias(label))
    known = with_label(rows, own, label, label_id="__id", how="inner", where=~held_out(F.col("__id")))
    one = known.groupBy(F.xxhash64("text").alias("copy")).agg(F.min("doc_id").alias("doc_id"), F.max(label).alias(label))
    known = with_label(rows, written(one), label, how="inner")
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5))
    model = train(known.where(fold != 0), label, every=True)
    chance = min(1.0, 5 * MOST_CALIBRATION_ROWS / max(1, labels.count()))
    few = known.where((fold == 0) & (F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * chance)))
    few = with_ratio(few.select("text", label), model).select(label, "__ratio").limit(2 * MOST_CALIBRATION_ROWS).toPandas()
    return Judge(model, *_fitted(few["__ratio"].to_numpy(float), few[label].to_numpy(float)))


def score_toxicity(df: DataFrame, labels: DataFrame, *, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", label_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 where score >= ``cut``) of each row of ``df``; ``fit`` says what is learnt from which rows.

    The score depends on the text alone: the log-likelihood ratio per word of the two models, through a logistic curve. Null and empty texts
    score as a document without evidence. Repeated rows are counted and scored each; null ids have no label. An empty table gives no rows.
    Other columns are not read.
    """
    judge = fit(df, labels, id_col=id_col, text_col=text_col, label=label, label_id=label_id)
    found = judge.scored(as_documents(df, id_col, text_col)).withColumnRenamed("__score", "score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(df: DataFrame, labels: DataFrame, *, cut: float = 0.7, text_col: str = "text", **options: str) -> DataFrame:
    """The rows of ``df``, with all their columns, whose score is below ``cut``: ``score_toxicity``'s verdict, taken where the rows are read."""
    judge = fit(df, labels, text_col=text_col, **options)
    return judge.scored(df, text_col).where(F.col("__score") < cut).drop("__score")
