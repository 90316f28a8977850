"""Spelling variants by anagram hashing.

1. Occurrences. Runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, are
   counted in each document and summed in each task before the counts meet. A run may be
   altered as the contract of the query says (``altered``).
2. Keys. A word's anagram key is the sum of the fifth powers of its letters' code points,
   as a 64-bit integer. A word is listed under its key and, for each letter that it has,
   under its key less that letter's power. So keys that differ by the value of one added
   or removed letter, or of one exchanged for another, meet by equality: a word's own key
   with a longer word's lesser key, or two lesser keys.
3. Letter order. Words that meet are near if their letters, in order, differ by exactly one
   insertion, deletion or replacement. A key with at most ``BUCKET`` words pairs these up
   and compares them. In a larger one, words are told apart first by what is left, in
   order, once a letter is out: by the hash of its place and the rest (replacement), or
   of the rest alone (insertion). At most an alphabet's words share such a hash, so no
   group makes all its pairs, and no pair is lost.
4. Forms are a word's near word of the largest count, roots the ends of the chains of
   forms, by pointer doubling.

Defined results: a null text has no words; a null doc_id counts as the empty text in the
hash that alters; repeated rows count as often as they come; without words there are no
rows. Other columns don't matter. Work on a very long word grows in proportion to its length
up to the comparison, which is Spark's own with a bound of one edit.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import slices, tidy
from weftgraph.operators.closure import representatives
from weftgraph.session import cut, ship

RUN = re.compile("[a-zÀ-ÿ]+")
#: Words of a key that are compared pair by pair; keys with more go by letter order.
BUCKET = 12
#: A task's counts are passed on once they hold so many letters.
HELD = 8 << 20
#: One run in so many, of those of a document, loses a letter.
ALTERED = 199

#: Fifth powers of the code points.
POWERS = np.arange(256, dtype=np.uint64) ** np.uint64(5)
#: Any odd number of 64 bits, and its inverse: powers of it are the weights of places.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def altered(run: str, seed: int) -> str:
    """The run without one letter, if its hash, carried on from that of its document, says so."""
    h = zlib.crc32(run.encode(), seed)
    if h % ALTERED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches):
    total: Counter = Counter()
    held = 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    for whole in batches:
        for batch in slices(whole, "text"):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not text:
                    continue
                # bytes.lower() lower-cases A-Z alone
                runs = Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in runs.items():
                    word = altered(run, seed)
                    held += len(word) if word not in total else 0
                    total[word] += n
                if held > HELD:
                    yield out()
                    total.clear()
                    held = 0
    if total:
        yield out()


def words(docs: DataFrame, min_length: int, min_count: int) -> DataFrame:
    """word, n: the words of at least so many code points and occurrences."""
    ship(docs.sparkSession)
    counts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(tidy(_counted), "word string, n long")
    return counts.where(F.length("word") >= min_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _letters(batch: pa.RecordBatch):
    """Of a batch of words: all letters in a row, the word each belongs to, and where the words start and how long they are."""
    coded = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
    sizes = np.array([len(w) for w in coded])
    letters = np.frombuffer(b"".join(coded), np.uint8)
    return letters, np.repeat(np.arange(len(coded)), sizes), np.cumsum(sizes) - sizes, sizes


def _keys(letters: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(POWERS[letters], starts)  # sums of 64 bits, whatever the length


def _listed(batches):
    """key, word, n, less: each word under its own key and, marked so, once under each lesser key."""
    for batch in batches:
        if not batch.num_rows:
            continue
        letters, word, starts, _ = _letters(batch)
        own = _keys(letters, starts)
        pairs = np.unique(word * 256 + letters)
        of, letter = pairs >> 8, pairs & 255
        at = pa.array(np.r_[np.arange(len(own)), of])
        keys = np.r_[own, own[of] - POWERS[letter]].view(np.int64)
        less = np.r_[np.zeros(len(own), bool), np.ones(len(of), bool)]
        yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(at), batch.column(1).take(at), pa.array(less)], names=["key", "word", "n", "less"])


def _ordered(batches):
    """key, rest, kind, word, n: what is left of a word without one letter, under its lesser key.

    kind 0: the word itself, which a longer one may leave; 1: the rest of a longer one;
    2: a rest together with the place of the letter that is out.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        letters, word, starts, sizes = _letters(batch)
        own = _keys(letters, starts)
        place = np.arange(len(letters)) - starts[word]
        weights = np.cumprod(np.r_[np.uint64(1), np.full(int(sizes.max()), BASE, np.uint64)])
        values = (POWERS[letters] + np.uint64(1)) * weights[place]
        total = np.add.reduceat(values, starts)
        upto = np.cumsum(values)  # with this letter, of all words so far; sums of 64 bits
        before = upto - values - (upto[starts] - values[starts])[word]
        rest = before + (total[word] - before - values) * np.uint64(INVERSE)
        lesser = own[word] - POWERS[letters]
        # of equal letters in a row each leaves the same rest
        once = np.r_[True, (letters[1:] != letters[:-1]) | (word[1:] != word[:-1])]
        with_place = rest + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        n = len(own)
        keys = np.r_[own, lesser[once], lesser].view(np.int64)
        rests = np.r_[total, rest[once], with_place].view(np.int64)
        kinds = np.repeat(np.arange(3, dtype=np.int32), [n, int(once.sum()), len(letters)])
        at = pa.array(np.r_[np.arange(n), word[once], word])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(rests), pa.array(kinds), batch.column(0).take(at), batch.column(1).take(at)], names=["key", "rest", "kind", "word", "n"]
        )


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """word, n, near, near_n: words (``vocabulary``: word, n) that differ by one inserted, deleted or replaced letter, both ways."""
    listed = vocabulary.mapInArrow(tidy(_listed), "key long, word string, n long, less boolean")
    met = cut(listed.groupBy("key").agg(F.count("*").alias("words")).where("words > 1"))
    one_edit = F.levenshtein(F.col("word"), F.col("near"), 1) == 1

    def both(rows: DataFrame, on: list[str], meets) -> DataFrame:
        other = rows.select(*on, *[F.col(c).alias(f"_{c}") for c in rows.columns if c not in on]).withColumnsRenamed({"_word": "near", "_n": "near_n"})
        return rows.join(other, on).where(meets & one_edit).select("word", "n", "near", "near_n")

    some = listed.join(met.where(F.col("words") <= BUCKET).select("key"), "key", "left_semi")
    paired = both(some, ["key"], F.col("less") | F.col("_less"))  # two own keys that are equal are no edit apart
    crowded = listed.join(met.where(F.col("words") > BUCKET).select("key"), "key", "left_semi").select("word", "n").distinct()
    ordered = crowded.mapInArrow(tidy(_ordered), "key long, rest long, kind int, word string, n long")
    ordered = ordered.join(met.where(F.col("words") > BUCKET).select("key"), "key", "left_semi")
    by_order = both(ordered, ["key", "rest"], (F.col("kind") + F.col("_kind")).isin(1, 4))
    return paired.unionByName(by_order)


def variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text): its near
    word of the largest count (ties: the first in code point order) is its form, if that comes
    at least ``factor`` times as often."""
    vocabulary = cut(words(docs, min_length, min_count))
    best = F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))
    near = near_pairs(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(best).alias("best"))
    likely = -F.col("best.n") >= F.col("n") * factor
    formed = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(likely, F.col("best.word")).alias("form"), F.when(likely, -F.col("best.n")).alias("form_n")
    )
    formed = cut(formed)
    roots = representatives(formed.where("form is not null").select(F.col("word").alias("a"), F.col("form").alias("b")))
    roots = roots.withColumnRenamed("a", "word")
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
