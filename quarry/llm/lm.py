"""Language-model scores: the marginal probability of a text over all its segmentations into subword pieces.

The pieces come with an existing vocabulary and its scores. From the training documents, one step of
expectation and maximisation makes of those scores the pieces' probabilities in this corpus: each distinct
word's segmentations, weighted by the existing scores, share out the word's count. A text's probability is the
product of its words' marginals, each found by forward recursion in log space, and of the end's.

What depends on a word only (its count, its marginal) is computed once for each distinct word, in a table that
grows with the corpus. The most frequent words, at most ``HEAD_WORDS`` whatever the corpus, are broadcast; all
others are met by a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import discard, written
from quarry.llm.text import LOWER, kept_by, slices, text_bytes, values
from quarry.llm.unigram import Lattice, vocabulary

#: Words that are broadcast, and the bytes that one of them may have: together a bound of a few MB.
HEAD_WORDS = 150_000
HEAD_BYTES = 48
#: Distinct words that a task counts before it hands them on.
COUNTED = 400_000


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 5; a null id is training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _word_counts(docs: DataFrame) -> DataFrame:
    """``word binary, c long, n long``: each distinct word's count in training and in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("lm")
        train, other = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            words = [*train, *other]
            c = [*train.values(), *[0] * len(other)]
            n = [*train.values(), *other.values()]
            train.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=["word", "c", "n"])

        for whole in batches:
            for batch in slices(whole, "__text"):
                for out, t in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
                    (other if out else train).update(t.translate(LOWER).split())
                if len(train) + len(other) >= COUNTED:
                    yield rows()
        yield rows()

    counted = docs.select("held_out", "__text").mapInArrow(run, "word binary, c long, n long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _expected(words: DataFrame, pieces: list[bytes], log_p: list[float]) -> list[float]:
    """How often the training words use each piece; the driver gets one number for each piece."""
    shared = words.sparkSession.sparkContext.broadcast((pieces, log_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("lm")
        pieces, log_p = shared.value
        lattice, counts = Lattice(pieces, log_p), [0.0] * len(pieces)
        for batch in batches:
            for word, c in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
                lattice.expect(word, c, counts)
        used = [k for k, x in enumerate(counts) if x]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([counts[k] for k in used], pa.float64())], names=["piece", "uses"])

    found = words.where("c > 0").select("word", "c").mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
    counts = [0.0] * len(pieces)
    for r in found:
        counts[r["piece"]] = r["uses"]
    return counts


def _marginals(words: DataFrame, pieces: list[bytes], log_p: list[float]) -> DataFrame:
    """``words`` with ``lp``, the log10 probability of each word over all its segmentations."""
    shared = words.sparkSession.sparkContext.broadcast((pieces, log_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("lm")
        lattice = Lattice(*shared.value)
        for batch in batches:
            lp = [lattice.forward(w) / math.log(10) for w in values(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp, pa.float64())], names=["word", "c", "n", "lp"])

    return words.select("word", "c", "n").mapInArrow(run, "word binary, c long, n long, lp double")


def _head_limit(words: DataFrame, most: int) -> int:
    """The least number of occurrences that at most ``most`` words reach, from a histogram of a few hundred rows."""
    bins = words.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).collect()
    held, limit = 0, 1 << 62
    for r in sorted(bins, key=lambda r: -r["bin"]):
        held += r["words"]
        if held > most:
            break
        limit = r["n"]
    return limit


def score(docs: DataFrame, model_path: str, *, doc_id: str = "doc_id", text: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """Scores of all whole texts: ``doc_id, held_out boolean, n_tokens, n_known, train_tokens long, base_score,
    score double`` (log10 probabilities).

    A text's tokens are its words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and one end. Training are the documents
    for which ``held_out`` is false. ``base_score`` sums ``log10((c + 0.5) / (N + 0.5 * (V + 1)))``, ``score`` is
    the piece model's. A null or empty text is its end alone. One row for each input row, repeated rows and null
    ids (training) included; an empty table gives none. Other columns are left out, whatever their names.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), text_bytes(docs, text).alias("__text"))
    ends = docs.select(held_out(F.col(doc_id)).alias("h")).where("NOT h").count()
    counted = written(_word_counts(source), "words")
    seen, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, kinds = seen + ends, distinct + (ends > 0)
    base_of = lambda c: math.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    pieces, prior = vocabulary(model_path)
    uses = _expected(counted, pieces, prior)
    mass = sum(uses) + ends + 0.5 * (len(pieces) + 1)
    log_p = [math.log((x + 0.5) / mass) for x in uses]
    end_lp = math.log10((ends + 0.5) / mass)
    words = written(_marginals(counted, pieces, log_p), "word-scores")
    discard(counted)
    head = words.where((F.col("n") >= _head_limit(words, head_words)) & (F.length("word") <= HEAD_BYTES)).select("word", "c", "lp").toArrow().to_pylist()
    shared = docs.sparkSession.sparkContext.broadcast({r["word"]: (base_of(r["c"]), r["lp"], r["c"] > 0) for r in head})
    end = (base_of(ends), end_lp, int(ends > 0))
    names = ["uid", "word", "tf", "doc_id", "n_tokens", "n_known", "base", "lp"]
    kinds_sql = f"uid long, word binary, tf long, doc_id {docs.schema[doc_id].dataType.simpleString()}, n_tokens long, n_known long, base double, lp double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("lm")
        known = shared.value
        uid = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, "__text"):
                uids, words, tfs, at = [], [], [], []
                n_tokens, n_known, bases, lps = [], [], [], []
                for row, t in enumerate(values(batch.column(1))):
                    uid += 1
                    tokens = t.translate(LOWER).split()
                    base, lp, met = end
                    for w, tf in Counter(tokens).items():
                        found = known.get(w)
                        if found is None:
                            uids.append(uid)
                            words.append(w)
                            tfs.append(tf)
                            at.append(None)
                        else:
                            base += tf * found[0]
                            lp += tf * found[1]
                            met += tf * found[2]
                    # The document's own row: its key holds a space, which no word does.
                    uids.append(uid)
                    words.append(b" %d" % uid)
                    tfs.append(0)
                    at.append(row)
                    n_tokens.append(len(tokens) + 1)
                    n_known.append(met)
                    bases.append(base)
                    lps.append(lp)
                index = pa.array(at, pa.int32())
                own = [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(bases, pa.float64()), pa.array(lps, pa.float64())]
                columns = [pa.array(uids, pa.int64()), pa.array(words, pa.binary()), pa.array(tfs, pa.int64()), *(c.take(index) for c in [batch.column(0), *own])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    # Written, as the numbers follow the order in which rows came: a task that runs again must not deal them anew.
    rows = written(source.select("doc_id", "__text").mapInArrow(run, kinds_sql), "document-words")
    other = words.select("word", F.col("c"), F.col("lp").alias("word_lp"))
    met = rows.join(other, "word", "left")
    word_base = F.log10((F.col("c") + 0.5) / F.lit(total + 0.5 * (kinds + 1)))
    zero = F.lit(0)
    summed = met.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", zero) + F.when(F.col("c") > 0, F.col("tf")).otherwise(zero)).alias("n_known"),
        F.sum(F.coalesce("base", F.col("tf") * word_base)).alias("base_score"),
        F.sum(F.coalesce("lp", F.col("tf") * F.col("word_lp"))).alias("score"),
    )
    return summed.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
