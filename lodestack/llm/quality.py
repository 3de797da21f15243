"""Quality rules: simple text statistics, then a hashed n-gram log-likelihood ratio of trusted target against raw corpus."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import as_documents, freeing, ngram_hashes, text_slices, with_label, word_hashes, worker_cache

#: Buckets of the two multinomials, and what is added to the target's counts per bucket on average, dealt out like the raw corpus: so little target
#: text says little, rather than that everything is rare in it.
BUCKETS, ADDED = 1 << 16, 1.0

#: Documents whose mean log-likelihood ratio per n-gram is below this go.
THRESHOLD = -0.12

#: Counted as symbols.
SYMBOLS = "#*$%&|<>"

WHITE = " \t\n\v\f\r"

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(text: str, words: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; ``words`` are its words' hashes in order."""
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    repeated = 0
    if len(words) >= 3:
        _, at, counts = np.unique(ngram_hashes(words, 3), return_inverse=True, return_counts=True)
        twice = counts[at] > 1
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(twice)] |= twice
        repeated = int(covered.sum())
    return len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def features(words: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the words and pairs of words of some documents, and which document each is of; the words first, then the pairs."""
    flat, owner = np.concatenate(words), np.repeat(np.arange(len(words)), [len(w) for w in words])
    pairs, same = (ngram_hashes(flat, 2), owner[1:] == owner[:-1]) if len(flat) > 1 else (flat[:0], np.zeros(0, bool))
    return (np.concatenate([ngram_hashes(flat, 1), pairs[same]]) % np.uint64(buckets)).astype(np.int64), np.concatenate([owner, owner[1:][same]])


def log_ratios(documents: DataFrame, *, buckets: int = BUCKETS, added: float = ADDED) -> np.ndarray:
    """log P(bucket | target) - log P(bucket | raw) for each bucket, from all of ``documents`` (text, is_target).

    Each task sums its documents into two arrays of ``buckets`` counts, Spark adds the tasks' arrays bucket by bucket;
    the driver gets ``buckets`` rows, however large the corpus.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("", dict)  # lets go of what other operators have kept
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for piece, texts in text_slices(batches, "text"):
            found, owner = features(word_hashes([(t or "").encode() for t in texts]), buckets)
            raw += np.bincount(found, minlength=buckets)
            trusted = piece.column("is_target").to_numpy(zero_copy_only=False)
            target += np.bincount(found[trusted[owner]], minlength=buckets)
        full = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(raw[full]), pa.array(target[full])], ["bucket", "raw", "target"])

    sums = documents.select("text", "is_target").mapInArrow(freeing(counted), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, a, b in sums.collect():
        raw[bucket], target[bucket] = a, b
    share = raw / max(1.0, raw.sum())
    weight = added * buckets
    full = raw > 0
    out = np.zeros(buckets)
    out[full] = np.log((target[full] + weight * share[full]) / (target.sum() + weight)) - np.log(share[full])
    return out


def judge_quality(df: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, min_words: int = 50, max_repeat_percent: int = 50, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", label_id: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    Base rule: fewer than ``min_words`` words, or more than ``max_repeat_percent`` % of them in 3-word windows that come twice, fails.
    Of the others those stay whose score is at least ``threshold``: the mean, over words and word pairs hashed into buckets, of the
    log-likelihood ratio between the trusted documents (``label`` = 1) and all documents. Every document's counts go into the
    corpus side, every trusted one's into the target side; the threshold is a constant, so equal texts get equal verdicts.

    A null text counts as empty: no words, base_failed, score null. Without labels, or with none that is 1, the
    ratio says nothing and the base rule alone decides. Repeated rows are counted and judged each; null ids have no label.
    Other columns are not read. Memory per task is two arrays of counts and one piece of text.
    """
    rows = as_documents(df, id_col, text_col)
    trusted = with_label(rows, labels, label, label_id=label_id).withColumn("is_target", F.coalesce(F.col(label) == 1, F.lit(False)))
    ratios = log_ratios(trusted)
    shared = df.sparkSession.sparkContext.broadcast(ratios.astype(np.float64))
    buckets = len(ratios)

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for piece, texts in text_slices(batches, "text"):
            words = word_hashes([(t or "").encode() for t in texts])
            stats = [statistics(text or "", own) for text, own in zip(texts, words)]
            found, owner = features(words, buckets)
            n = np.bincount(owner, minlength=len(words))
            scores = np.bincount(owner, ratio[found], minlength=len(words)) / np.maximum(n, 1)
            columns = [pa.array(c, pa.int64()) for c in zip(*stats)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns, pa.array(scores, pa.float64(), mask=n == 0)], ["doc_id", *STATISTICS, "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(freeing(judged), f"doc_id {kind}, {', '.join(f'{c} long' for c in STATISTICS)}, score double")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    kept = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & kept).select("doc_id", *STATISTICS, "base_failed", "kept", "score")
