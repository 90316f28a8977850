"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint has 64 bits; one is set if it is set in over half the hashes of a
text's shingles. Two fingerprints that differ in at most two bits differ in at
most one in one of their two 32-bit segments. So each distinct fingerprint is
indexed, for both segments, under the segment itself and under the 32 variants
with one bit left out; an equality join finds the pairs, which are verified on all
64 bits. Copies of a text share a fingerprint and are joined only at the end.

A key that more than ``BUCKET`` fingerprints share isn't paired up. Its
fingerprints go another exact way: each is listed under itself and its 64
neighbours at one bit; two fingerprints differ in at most two bits exactly if they
share such a centre, and a centre has at most 65, so each is tied to the least.
No link is lost, and no step makes all pairs of a large group.

Components come from these links by star contraction, and each has the smallest
doc_id of its documents.

Defined results: a text without words (null and empty ones too) has fingerprint 0
and is linked like any other; a text with fewer words than a shingle is one
shingle; repeated rows are rows of one component; a component without any doc_id
has a null id; an empty table gives no rows. Other columns pass, but for those named like the new ones.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import append_columns, slices, tidy, without, words_of
from weftgraph.operators.closure import components
from weftgraph.session import cut

SEED = 42
#: Fingerprints that a key may tie pair by pair; keys with more go by centres.
BUCKET = 16
#: Hashes whose bits are counted at once.
CHUNK = 1 << 15


def shingle_hashes(words: list[bytes], n: int) -> list[int]:
    if not words:
        return []
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
    starts = [0, *[e + 1 for e in ends[: len(words) - n]]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :], strict=True)]


def fingerprint(hashes: list[int]) -> int:
    if not hashes:
        return 0
    total = np.zeros(64, np.int64)
    h = np.array(hashes, np.uint64)
    for i in range(0, len(h), CHUNK):
        part = h[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` without its text, with fp: the 64 bits as a signed long."""
    out = append_columns(docs.drop(text), [T.StructField("fp", T.LongType())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text):
                texts = batch.column(batch.schema.get_field_index(text))
                fps = np.array([fingerprint(shingle_hashes(words_of(x), shingle)) for x in texts.to_pylist()], np.uint64)
                arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in out.fields[:-1]]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(fps.view(np.int64))], names=[f.name for f in out.fields])

    return docs.mapInArrow(tidy(run), out)


def _variants(batches):
    """key, fp: both segments as they are and with each bit left out. A key names segment, bit and rest."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        bits = np.arange(33, dtype=np.uint64)
        keys = []
        for s in range(2):
            segment = (fp >> np.uint64(32 * s)) & np.uint64(0xFFFFFFFF)
            left_out = np.where(bits < 32, np.uint64(1) << np.minimum(bits, np.uint64(31)), np.uint64(0))
            rest = segment[:, None] & ~left_out[None, :]
            keys.append((rest | (bits[None, :] << np.uint64(32)) | (np.uint64(s) << np.uint64(38))).astype(np.int64))
        keys = np.concatenate(keys, axis=1)
        fps = np.repeat(fp.view(np.int64), keys.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(fps)], names=["key", "fp"])


def _centres(batches):
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
        keys = (fp[:, None] ^ flips[None, :]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(fp.view(np.int64), 65))], names=["key", "fp"])


LINKS = "u long, v long"


def _groups(batches, most: int):
    """Sorted rows (key, fp) as whole groups: (key, fp, starts), and apart (None, fp, None), the members of groups over ``most``."""
    key = np.empty(0, np.int64)
    fp = np.empty(0, np.int64)
    large = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        over = sizes > most
        if large is not None and key[0] == large:
            over[0] = True
        open_ = not over[-1]  # the last group may go on in the next batch
        large = None if open_ else int(key[-1])
        done = np.ones(len(starts), bool)
        done[-1] = not open_
        rows_over = np.repeat(over, sizes)
        rows_done = np.repeat(done & ~over, sizes)
        if rows_over.any():
            yield None, fp[rows_over], None
        if rows_done.any():
            k, f = key[rows_done], fp[rows_done]
            yield k, f, np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        tail = starts[-1] if open_ else len(key)
        key, fp = key[tail:], fp[tail:]
    if len(key):
        yield key, fp, np.flatnonzero(np.r_[True, key[1:] != key[:-1]])


def _links(batches):
    """Verified pairs of each group; a row (u, u) marks a member of a group that is too large."""
    for key, fp, starts in _groups(batches, BUCKET):
        if key is None:
            fp = np.unique(fp)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(fp)], names=["u", "v"])
            continue
        sizes = np.diff(np.r_[starts, len(key)])
        last = np.repeat(starts + sizes, sizes)
        bit, segment = (key >> 32) & 63, (key >> 38) & 1
        at = np.where(bit < 32, bit + 32 * segment, 0).astype(np.uint64)
        left, right = [], []
        rows = np.arange(len(key))
        for step in range(1, int(sizes.max())):
            rows = rows[rows + step < last[rows]]
            other = fp[rows] ^ fp[rows + step]
            near = np.bitwise_count(other.view(np.uint64)) <= 2
            # under a variant only pairs that differ in the bit left out: the others meet under the segment itself
            near &= (bit[rows] == 32) | ((other.view(np.uint64) >> at[rows]) & np.uint64(1) == 1)
            left.append(fp[rows[near]])
            right.append(fp[rows[near] + step])
        if left and sum(map(len, left)):
            a, b = np.concatenate(left), np.concatenate(right)
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def _stars(batches):
    for key, fp, starts in _groups(batches, 1 << 30):
        sizes = np.diff(np.r_[starts, len(key)])
        least = np.repeat(fp[starts], sizes)
        ok = fp != least
        pairs = np.unique(np.stack([fp[ok], least[ok]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def near_links(distinct: DataFrame) -> DataFrame:
    """u, v: links between distinct fingerprints (fp) that tie together all that differ in at most two bits."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def grouped(rows, step):
        return rows.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(tidy(step), LINKS)

    found = cut(grouped(distinct.mapInArrow(tidy(_variants), "key long, fp long"), _links).distinct())
    crowded = found.where("u = v").select(F.col("u").alias("fp"))
    stars = grouped(crowded.mapInArrow(_centres, "key long, fp long"), _stars)
    return found.where("u <> v").unionByName(stars)


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` without its text, with fp, root (the least fingerprint of the component) and component_id."""
    marked = cut(fingerprints(without(docs, "root", "component_id"), text, shingle))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(distinct.select("fp")))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(classes.join(named, "root").select("fp", "root", "component_id"), "fp")
