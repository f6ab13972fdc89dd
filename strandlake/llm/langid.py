"""Language identification by multilingual mixture inference.

Each language has smoothed probabilities of hashed byte trigrams. A document's trigrams are taken as
drawn from a mixture of languages; expectation-maximisation estimates the proportions, and among the
nested sets of its strongest languages the one of the best penalised likelihood is kept. The
language of the largest proportion is the prediction and that proportion its score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import remainder, slices

#: Expected rows of each language that the trigram model is fitted on (chosen by hash of doc_id).
ROWS_PER_LANGUAGE = 3000
BUCKETS = 1 << 16
#: Languages of one model (half a megabyte each); more are an error, none is left out.
MAX_LANGUAGES = 400
ROUNDS = 12
UNKNOWN = "und"

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigrams(text: str) -> np.ndarray:
    """Bucket numbers of the byte trigrams of the lower-cased text, anything but letters as a space."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
    grams = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    grams = grams[(data[1:-1] != 32) | (data[2:] != 32)]
    return ((grams * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages sorted, probabilities: BUCKETS by languages) from text and lang of rows whose
    crc32(doc_id as text) mod 4 is not 2; rows with null text or lang teach nothing."""
    own = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    sizes = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    languages = sorted(sizes)
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} values of lang are over MAX_LANGUAGES")
    if not languages:
        return [], np.zeros((BUCKETS, 0))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, rows_per_language / sizes[k])))])
    place = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    sample = own.where(place < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches, 1):
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                totals[lang] = totals.get(lang, 0) + np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    counts = np.zeros((BUCKETS, len(languages)))
    number = {k: i for i, k in enumerate(languages)}
    for r in sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket, number[r.lang]] = r.n
    counts += 0.05
    return languages, counts / counts.sum(axis=0)


def _em(p: np.ndarray, n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions after ROUNDS of expectation-maximisation and the log-likelihood that they give."""
    share, total = start, n.sum()
    for _ in range(ROUNDS):
        share = share * ((n / (p @ share)) @ p) / total
    return share, float(n @ np.log(p @ share))


def mixture(text: str, probabilities: np.ndarray) -> np.ndarray:
    """Language proportions of a text (zero for languages outside the selected set); sums to 1."""
    k = probabilities.shape[1]
    grams, n = np.unique(trigrams(text), return_counts=True)
    if not len(grams):
        return np.full(k, 1 / k)
    p = probabilities[grams]
    share, _ = _em(p, n, np.full(k, 1 / k))
    order = np.argsort(-share, kind="stable")
    cost = 0.5 * np.log(n.sum()) * 2
    best, best_value = None, -np.inf
    for size in range(1, k + 1):
        chosen = order[:size]
        if size == 1:
            value, own = float(n @ np.log(p[:, chosen[0]])), np.ones(1)
        else:
            own, value = _em(p[:, chosen], n, share[chosen] / share[chosen].sum())
            value -= cost * (size - 1)
        if value <= best_value:
            break
        best, best_value = (chosen, own), value
    out = np.zeros(k)
    out[best[0]] = best[1]
    return out


def languages_of(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score, languages map<string,double>) for every row of docs (doc_id, text)."""
    languages, probabilities = model
    shared = docs.sparkSession.sparkContext.broadcast(probabilities)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.MapType(T.StringType(), T.DoubleType()))])
    names = schema.names

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            best, score, shares = [], [], []
            for text in batch.column(1).to_pylist():
                if not languages or not has_letter(text):
                    best.append(UNKNOWN)
                    score.append(0.0)
                    shares.append([])
                    continue
                share = mixture(text, shared.value)
                top = int(np.argmax(share))
                best.append(languages[top])
                score.append(min(1.0, float(share[top])))
                shares.append([(languages[i], float(share[i])) for i in np.flatnonzero(share)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))], names=names)

    return docs.select("doc_id", "text").mapInArrow(infer, schema)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages) for every row, by a model of the same rows.

    `und` with score 0 if the text is null or has no letter, or if no row teaches a language; ties go
    to the language first in order; long texts are read whole; repeated rows get equal values; an empty table gives
    an empty one; other columns are ignored. More than MAX_LANGUAGES values of lang are an error.
    """
    found = languages_of(docs, fit(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "languages")
