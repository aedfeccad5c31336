"""Language ID: averaged embeddings of hashed subwords under a linear softmax, fitted by SGD in numpy.

A text is the mean of the embeddings of its subwords: all byte n-grams of its words, the
blank before and after a word included.  The fit runs on a bounded sample; the
prediction covers every text whole.  A part of the sample that the fit never sees sets
the softmax temperature and the confidence below which a text is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import extended, flat, output, slices, table, trim, unclashed
from codelake.llm.registry import query

UNDETERMINED = "und"
BUCKETS = 1 << 14
#: Bounds of the sample that the model is fitted on: for each language, and in all.
MAX_TEXTS_PER_LANGUAGE, MAX_TEXTS = 400, 100_000
#: Numbers that a task holds while it adds up what subwords say of languages.
SCORED = 1 << 22
#: Their counts and a column of weights each are held by the driver and broadcast.
MAX_LANGUAGES = 5000

_LETTER = regex.compile(r"\p{L}")
#: Bytes other than letters are blanks here; bytes over 127 are parts of letters.
_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[128:] = np.arange(128, 256)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)


def subwords(data: np.ndarray, offsets: np.ndarray, sizes=(2, 3, 4)):
    """For each n-gram size: the bucket of every n-gram and the number of its text.

    N-grams have no blank inside, at most one at either end.
    """
    clean = _CLEAN[data]
    blank = clean == 0x20
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    code, inner = clean.astype(np.uint32), np.zeros(len(clean), bool)
    for n in range(2, max(sizes) + 1):
        m = len(clean) - n + 1
        if m <= 0:
            return
        code = code[:m] | (clean[n - 1 :].astype(np.uint32) << np.uint32(8 * (n - 1)))
        inner = inner[:m] | blank[n - 2 : n - 2 + m] if n > 2 else inner[:m]
        if n in sizes:
            whole = ~inner & (doc[:m] == doc[n - 1 :]) & ~(blank[:m] & blank[n - 1 :])
            hashed = (code[whole] * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519)
            yield (hashed >> np.uint32(18)).astype(np.int64), doc[:m][whole]


@dataclass
class LanguageModel:
    languages: list[str]
    embeddings: np.ndarray  # buckets x width
    weights: np.ndarray  # width x languages
    bias: np.ndarray
    temperature: float
    reject_below: float

    def scores(self) -> np.ndarray:
        """Embedding times weights: what one subword adds to every language's logit before the mean."""
        return (self.embeddings @ self.weights).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(samples, width: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """``samples``: (language, buckets, shares) of texts; every fifth only calibrates."""
    languages = sorted({s[0] for s in samples})
    number = {x: k for k, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    held = [s for k, s in enumerate(samples) if k % 5 == 4]
    taught = [s for k, s in enumerate(samples) if k % 5 != 4]
    model = LanguageModel(languages, rng.normal(0, 0.1, (BUCKETS, width)), np.zeros((width, len(languages))), np.zeros(len(languages)), 1.0, 0.0)
    model.weights += rng.normal(0, 0.1, model.weights.shape)
    steps, step = max(1, epochs * len(taught)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(taught)):
            language, buckets, shares = taught[k]
            lr = rate * (1 - step / steps)
            step += 1
            mean = shares @ model.embeddings[buckets]
            error = softmax(mean @ model.weights + model.bias)
            error[number[language]] -= 1
            back = model.weights @ error
            model.weights -= lr * np.outer(mean, error)
            model.bias -= lr * error * 0.1
            # a mean moves as one: the step isn't shrunk by the number of subwords
            model.embeddings[buckets] -= lr * 20 * shares[:, None] * back[None, :]
    if held:
        z = np.array([s[2] @ model.embeddings[s[1]] @ model.weights + model.bias for s in held])
        truth = np.array([number[s[0]] for s in held])
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(z)), truth] + 1e-12).mean()
        model.temperature = float(min((0.5 * 1.25**k for k in range(16)), key=loss))
        p = softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == truth]
        model.reject_below = float(min(0.5, np.quantile(right, 0.005))) if len(right) else 0.0
    return model


def training_sample(labelled: DataFrame, order: Column, per_language: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """At most about ``per_language`` texts of each language, chosen by a hash; only their bucket counts reach the driver."""
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    per_language = max(1, min(per_language, MAX_TEXTS // max(1, len(counts))))
    # a row for each language, so every text is judged where it is read
    counts = labelled.sparkSession.createDataFrame(counts, "lang string, _n bigint")
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("_n"))
    chosen = labelled.join(F.broadcast(counts), "lang").filter(F.pmod(order, F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = flat(part.column("text"))
                found = list(subwords(data, offsets))
                bucket = np.concatenate([b for b, _ in found]) if found else np.zeros(0, np.int64)
                doc = np.concatenate([d for _, d in found]) if found else np.zeros(0, np.int32)
                keys, n = np.unique(doc.astype(np.int64) * BUCKETS + bucket, return_counts=True)
                cuts = np.searchsorted(keys, np.arange(len(part) + 1) * BUCKETS)
                rows = [(keys[a:b] % BUCKETS, n[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    part.column("lang"), pa.array([k.astype(np.int32).tobytes() for k, _ in rows], pa.binary()),
                    pa.array([(c / max(1, c.sum())).astype(np.float32).tobytes() for _, c in rows], pa.binary())], ["lang", "buckets", "shares"])

    rows = chosen.mapInArrow(count, "lang string, buckets binary, shares binary").filter(F.length("buckets") > 0).collect()
    # an order of its own makes the fit the same however the rows arrive
    rows = sorted(rows, key=lambda r: (hash_order(bytes(r["buckets"]), bytes(r["shares"])), r["lang"]))
    return [(r["lang"], np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32).astype(float)) for r in rows]


def hash_order(*values: bytes) -> bytes:
    import hashlib

    return hashlib.sha256(b"".join(values)).digest()


def train(labelled: DataFrame, order: Column, per_language: int = MAX_TEXTS_PER_LANGUAGE) -> LanguageModel | None:
    """A model of the non-null ``lang`` of a table (lang, text); None without any usable text."""
    samples = training_sample(labelled.filter("lang IS NOT NULL AND text IS NOT NULL"), order, per_language)
    return fit(samples) if samples else None


def predict(df: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """All rows with lang_pred, score (confidence, 0 to 1) and rejected.

    A text that is null or has no letter gets ``und`` with score 0 and is rejected; so is
    every text without a model.  A text below the calibrated confidence is rejected but
    keeps its best guess; equal logits go to the first language by name.  Columns with
    these three names are replaced.
    """
    frame = unclashed(df, ["lang_pred", "score", "rejected"])
    schema = extended(frame, "lang_pred string, score double, rejected boolean")
    shared = frame.sparkSession.sparkContext.broadcast(
        model and (model.languages, model.scores(), model.bias, model.temperature, model.reject_below))

    def run(batches):
        known = shared.value
        for batch in batches:
            for part in slices(batch, text):
                n = len(part)
                data, offsets = flat(part.column(text))
                ascii_letter = np.zeros(len(data) + 1, np.int64)
                np.cumsum((_CLEAN[data] != 0x20) & (data < 128), out=ascii_letter[1:])
                letters = np.diff(ascii_letter[offsets]) > 0
                for k in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
                    letters[k] = bool(_LETTER.search(part.column(text)[int(k)].as_py()))
                guess, score = np.full(n, UNDETERMINED, object), np.zeros(n)
                rejected = np.ones(n, bool)
                if known and letters.any():
                    languages, scores, bias, temperature, least = known
                    logits, total = np.zeros((n, len(languages))), np.zeros(n)
                    for bucket, doc in subwords(data, offsets):
                        step = max(1, SCORED // len(languages))
                        for a in range(0, len(bucket), step):
                            cuts = np.searchsorted(doc[a : a + step], np.arange(n + 1))
                            full = np.flatnonzero(np.diff(cuts))
                            logits[full] += np.add.reduceat(scores[bucket[a : a + step]], cuts[full], axis=0)
                            total += np.diff(cuts)
                    p = softmax((logits / np.maximum(total, 1)[:, None] + bias) / temperature)
                    best = p.argmax(axis=1)
                    guess[letters] = np.array(languages, object)[best[letters]]
                    score[letters] = p.max(axis=1)[letters]
                    rejected = ~letters | (score < least)
                yield output(part, part.schema.names, lang_pred=pa.array(guess, pa.string()), score=score, rejected=rejected)
            trim()

    return frame.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, per_language: int = MAX_TEXTS_PER_LANGUAGE) -> DataFrame:
    """Documents with held_out, lang_pred, score and rejected; only documents with an id that isn't held out teach."""
    teach = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", "doc_id")
    model = train(teach, F.xxhash64("doc_id"), per_language)
    return predict(unclashed(docs, ["held_out"]).withColumn("held_out", held_out(F.col("doc_id"))), model)


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    teach = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", "doc_id")
    model = train(teach, F.xxhash64("doc_id"))
    asked = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(asked, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
