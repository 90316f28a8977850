"""Line deduplication: which lines of which documents to keep.

Every line's key (the line stripped and lower-cased) is hashed to 128 bits, taken
as its identity. The hashes are range-partitioned and sorted by hash, document and
position. The ranges are cut at (hash, document, position), so a line that a third
of all documents hold is dealt over as many partitions as its rows need. A first
pass sums up each partition's first and last hash in one row; from these rows, as
many as there are partitions, the driver knows of each hash that crosses a border
in how many documents it is found and where it comes first. A second pass streams
each partition once and emits the lines to drop. What comes back is, for each
document that loses lines, a compressed bitmap of the lines to keep, and never text.

Modes: ``all`` drops every line whose key is found in at least ``min_docs``
documents; ``later`` drops all of these but the first occurrence.

Defined results: a null or an empty text is one empty line; keys shorter than
``min_chars`` code points are kept; rows with one doc_id are one document when
documents are counted, and all null ids are one document; rows that repeat both id
and text get the same decision, so both keep a first occurrence; an empty table
gives no rows. Only doc_id and text are read; other columns pass, but for those named like the new ones.
"""

from __future__ import annotations

import hashlib
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import WS, append_columns, slices, tidy, without
from weftgraph.session import cut, ship

STRIP = WS.encode()
#: Rows of one hash that a task holds in memory; more go to a file until the hash's documents are counted.
HELD = 1 << 20
LINES = "h1 long, h2 long, doc long, th long, pos int, n int"


def row_names() -> list:
    """Columns doc and th, the pair that names a row up to repetition."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return [doc.alias("doc"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th")]


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                docs_, ths, texts = (batch.column(i) for i in range(3))
                digests, rows, places, counts = [], [], [], []
                for i, text in enumerate(texts.to_pylist()):
                    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                    for j, line in enumerate(lines):
                        key = line.strip(STRIP).lower()
                        if len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                            digests.append(hashlib.md5(key, usedforsecurity=False).digest())
                            rows.append(i)
                            places.append(j)
                            counts.append(len(lines))
                h = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
                at = np.array(rows, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0]), pa.array(h[:, 1]), docs_.take(pa.array(at)), ths.take(pa.array(at)), pa.array(places, pa.int32()), pa.array(counts, pa.int32())],
                    names=["h1", "h2", "doc", "th", "pos", "n"],
                )

    return docs.select(*row_names(), "text").mapInArrow(tidy(run), LINES)


class _Rows:
    """Rows sorted by hash, document and position, as arrays."""

    def __init__(self, columns: list[np.ndarray]):
        self.columns = columns
        self.h1, self.h2, self.doc = columns[:3]

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Rows:
        return cls([c.to_numpy(zero_copy_only=False) for c in batch.columns])

    def __len__(self) -> int:
        return len(self.h1)

    def __getitem__(self, part: slice) -> _Rows:
        return _Rows([c[part] for c in self.columns])

    def after(self, other: _Rows | None) -> _Rows:
        return self if other is None or not len(other) else _Rows([np.concatenate(p) for p in zip(other.columns, self.columns, strict=True)])

    def starts(self) -> np.ndarray:
        """Where a new hash begins."""
        return np.flatnonzero(np.r_[True, (self.h1[1:] != self.h1[:-1]) | (self.h2[1:] != self.h2[:-1])])

    def name(self, i: int) -> tuple[int, int]:
        return int(self.h1[i]), int(self.h2[i])

    def place(self, i: int) -> tuple[int, int, int]:
        return tuple(int(c[i]) for c in self.columns[2:5])


def _doc_counts(rows: _Rows, starts: np.ndarray) -> np.ndarray:
    new = np.r_[True, rows.doc[1:] != rows.doc[:-1]]
    new[starts] = True
    return np.add.reduceat(new.astype(np.int64), starts)


SUMMARY = "part int, side int, h1 long, h2 long, docs long, first_doc long, last_doc long, doc long, th long, pos int, whole boolean"


def _summarise(batches):
    """Two rows for a partition: its first hash and its last, each with its number of documents here."""
    first = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _Rows.of(batch)
        starts = rows.starts()
        counts = _doc_counts(rows, starts)
        for k in sorted({0, len(starts) - 1}):
            a = int(starts[k])
            b = int(starts[k + 1]) - 1 if k + 1 < len(starts) else len(rows) - 1
            if last is not None and last["name"] == rows.name(a):
                last["docs"] += int(counts[k]) - (last["last_doc"] == int(rows.doc[a]))
                last["last_doc"] = int(rows.doc[b])
            else:
                last = {"name": rows.name(a), "docs": int(counts[k]), "first_doc": int(rows.doc[a]), "last_doc": int(rows.doc[b]), "place": rows.place(a)}
                first = first or last
    if first is None:
        return
    part = TaskContext.get().partitionId()
    sides = [(0, first)] if first is last else [(0, first), (1, last)]
    yield pa.RecordBatch.from_pylist(
        [
            {"part": part, "side": s, "h1": x["name"][0], "h2": x["name"][1], "docs": x["docs"], "first_doc": x["first_doc"], "last_doc": x["last_doc"]}
            | dict(zip(("doc", "th", "pos"), x["place"], strict=True)) | {"whole": first is last}
            for s, x in sides
        ],
        schema=pa.schema([("part", pa.int32()), ("side", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("docs", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("whole", pa.bool_())]),
    )


def across_borders(rows: list) -> dict[tuple[int, int], tuple[int, tuple[int, int, int]]]:
    """Of each hash that crosses a border between partitions: its documents, and its first place."""
    out: dict = {}
    previous = None
    for r in sorted(rows, key=lambda r: (r["part"], r["side"])):
        name = (r["h1"], r["h2"])
        if previous is not None and previous["name"] == name:
            previous["docs"] += r["docs"] - (previous["last_doc"] == r["first_doc"])
            previous["last_doc"] = r["last_doc"]
            out[name] = (previous["docs"], previous["place"])
        else:
            previous = {"name": name, "docs": r["docs"], "last_doc": r["last_doc"], "place": (r["doc"], r["th"], r["pos"])}
    return out


DROPPED = "doc long, th long, pos int, n int"


class _Spool:
    """Rows put by until it is known what becomes of them: up to ``HELD`` in memory, more in a file of the task's own."""

    def __init__(self):
        self.rows, self.n, self.file, self.parts = [], 0, None, 0

    def add(self, rows: _Rows) -> None:
        self.rows.append(np.stack([c.astype(np.int64) for c in rows.columns]))
        self.n += len(rows)
        if self.n > HELD:
            self.file = self.file or tempfile.TemporaryFile()
            np.save(self.file, np.concatenate(self.rows, axis=1))
            self.rows, self.n, self.parts = [], 0, self.parts + 1

    def __iter__(self):
        if self.file:
            self.file.seek(0)
            for _ in range(self.parts):
                yield np.load(self.file)
        yield from self.rows

    def close(self) -> None:
        if self.file:
            self.file.close()


def _drops(batches, crossing: dict, min_docs: int, mode: str):
    """Stream sorted rows. Of the hash that a batch ends with it is known in how many documents it was
    found and where first; its rows are put by only while these are too few to tell."""

    def out(columns, drop) -> pa.RecordBatch:
        doc, th, pos, n = (c[drop] for c in columns)
        arrays = [pa.array(doc.astype(np.int64)), pa.array(th.astype(np.int64)), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, names=["doc", "th", "pos", "n"])

    def told(columns, first) -> np.ndarray:
        """Which rows of a frequent hash go."""
        if mode != "later":
            return np.ones(len(columns[0]), bool)
        return (columns[0] != first[0]) | (columns[1] != first[1]) | (columns[2] != first[2])

    name, docs, last_doc, first, frequent, spool = None, 0, None, None, False, _Spool()
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _Rows.of(batch)
        starts = rows.starts()
        counts = _doc_counts(rows, starts)
        places = [c[starts].astype(np.int64) for c in rows.columns[2:5]]
        if rows.name(0) == name:
            counts[0] += docs - (last_doc == int(rows.doc[0]))
            for of, value in zip(places, first, strict=True):
                of[0] = value
        else:
            spool.close()
            name, frequent, spool = None, False, _Spool()
        often = counts >= min_docs
        for k in {0, len(starts) - 1}:
            known = crossing.get(rows.name(int(starts[k])))
            if known is not None:
                often[k] = known[0] >= min_docs
                for of, value in zip(places, known[1], strict=True):
                    of[k] = value
        if name is not None and often[0] and not frequent:
            at = [of[0] for of in places]
            for part in spool:
                yield out(part[2:6], told(part[2:5], at))
            spool.close()
            spool = _Spool()
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(rows)]))
        drop = often[group]
        if drop.any():
            if mode == "later":
                drop &= told(rows.columns[2:5], [of[group] for of in places])
            yield out(rows.columns[2:6], drop)
        last = int(starts[-1])
        if len(starts) > 1:
            spool.close()
            spool = _Spool()
        name, docs, last_doc, frequent = rows.name(last), int(counts[-1]), int(rows.doc[-1]), bool(often[-1])
        first = [of[-1] for of in places]
        if not frequent and name not in crossing:
            spool.add(rows[slice(last, None)])
    spool.close()


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, mode: str = "all") -> DataFrame:
    """doc, th (``row_names``), n_dropped and keep_bits of each document that loses lines; the bits are packed, then deflated."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", "doc", "th", "pos"]
    lines = cut(line_hashes(docs, min_chars).repartitionByRange(n, *order).sortWithinPartitions(*order))
    crossing = across_borders(lines.mapInArrow(_summarise, SUMMARY).collect())  # two rows per partition at most
    dropped = lines.mapInArrow(tidy(lambda b: _drops(b, crossing, min_docs, mode)), DROPPED)
    by_doc = dropped.groupBy("doc", "th").agg(F.max("n").alias("n"), F.collect_set("pos").alias("gone"))

    def pack(batches):
        for batch in batches:
            bits = []
            for n_lines, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                keep = np.ones(n_lines, np.uint8)
                keep[gone] = 0
                bits.append(zlib.compress(np.packbits(keep).tobytes()))
            sizes = pa.array([len(g) for g in batch.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, pa.array(bits, pa.binary())], names=["doc", "th", "n_dropped", "keep_bits"])

    return by_doc.mapInArrow(pack, "doc long, th long, n_dropped long, keep_bits binary")


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its dropped lines taken out of ``text``, and n_lines and n_dropped. A null text without dropped lines stays null."""
    docs = without(docs, "n_lines", "n_dropped", "keep_bits")
    bits = keep_bitmaps(docs, **options).select("doc", "th", "keep_bits")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_names())
    joined = rows.join(bits.hint("shuffle_hash"), ["doc", "th"], "left").select("row.*", "keep_bits")
    out = append_columns(joined.drop("keep_bits"), [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                index = {f.name: i for i, f in enumerate(batch.schema)}
                texts, n_lines, n_dropped = [], [], []
                for text, bits in zip(batch.column(index["text"]).to_pylist(), batch.column(index["keep_bits"]).to_pylist(), strict=True):
                    lines = (text or "").split("\n")
                    n_lines.append(len(lines))
                    if bits is None:
                        texts.append(text)
                        n_dropped.append(0)
                        continue
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=len(lines))
                    texts.append("\n".join(line for line, k in zip(lines, keep, strict=True) if k))
                    n_dropped.append(len(lines) - int(keep.sum()))
                made = {"text": pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
                yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(index[f.name]) for f in out.fields], names=[f.name for f in out.fields])

    return joined.mapInArrow(tidy(run), out)
