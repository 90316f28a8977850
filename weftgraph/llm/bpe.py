"""BPE encoding and decoding with a published byte-level vocabulary.

Encoding: each piece of the pre-tokenizer is encoded by backtracking. An
Aho-Corasick automaton gives the longest token that starts at every position;
the encoder takes the longest token that fits its left neighbour and falls back
to the token's next shorter prefix token, or to an earlier position, when no
token fits. Two tokens fit when merging their joined bytes would leave the two
apart; since a sequence whose neighbours all fit is the merged sequence, the
outcome equals applying the merges one by one, in time linear in the piece.
Decoding: all token bytes lie in one block; an offset table gives each id's
range, and a document is one vectorised gather.

Defined results: a null text encodes like the empty text (no ids, decoded to the
empty text); the special token's string in a text becomes its id, as the
tokenizers library does by default; rows are kept one to one, repeats included;
a column of the input named like an output column is replaced.
"""

from __future__ import annotations

import hashlib
import json

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftgraph.llm.common import append_columns, slices, tidy

#: Fixed value: the published pre-tokenization pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces whose encoding a worker remembers, in each of two generations.
MEMORY = 400_000
#: Pairs of tokens whose fit it remembers.
PAIRS = 400_000

NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary file: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The tables made from a vocabulary file: token bytes, merges, special tokens."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        alphabet = byte_alphabet()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.ids = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in self.ids.items():
            self.bytes_of[i] = t
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        # merge of two ids -> (rank, id made); of each id, the merge that makes it
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.born = [-1] * size
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self.merges.setdefault((a, b), (rank, made))
            if self.parts[made] is None:
                self.parts[made], self.born[made] = (a, b), rank
        # each token's longest proper prefix that is a token
        self.shorter = [-1] * size
        for t, i in self.ids.items():
            self.shorter[i] = next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.length = [len(t) for t in self.bytes_of]
        # decoding: one block and the offsets of the ids in it
        self.block = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.bytes_of])]).astype(np.int64)
        self.fit: dict[tuple[int, int], bool] = {}
        self.pieces = regex.compile(PATTERN)
        self.splits = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = _Known(self)

    def fits(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` stay apart when their joined bytes are merged.

        Walk back in time from the finished pair: the two pieces that touch at the
        border were there together until one of them was merged away. If they could
        have merged with each other before that, the pair never comes about. Of
        merges of equal rank the left one comes first.
        """
        key = (a, b)
        known = self.fit.get(key)
        if known is not None:
            return known
        a_until, b_until, fits = NEVER, NEVER, True
        while True:
            merge = self.merges.get((a, b))
            if merge is not None and merge[0] < a_until and merge[0] <= b_until:
                fits = False
                break
            a_born, b_born = self.born[a], self.born[b]
            if a_born < 0 and b_born < 0:
                break
            if a_born >= b_born:
                a_until, a = a_born, self.parts[a][1]
            else:
                b_until, b = b_born, self.parts[b][0]
        if len(self.fit) > PAIRS:
            self.fit.clear()
        self.fit[key] = fits
        return fits

    def encode_piece(self, piece: bytes) -> list[int]:
        n, text = len(piece), piece.decode("latin-1")
        longest = [0] * n
        for end, (token, size) in self.automaton.iter(text):
            longest[end + 1 - size] = token  # later ends are longer
        if self.length[longest[0]] == n:
            return [longest[0]]
        length, shorter, fits = self.length, self.shorter, self.fits
        out: list[int] = []
        dead = bytearray(n + 1)  # positions from which no token fits what led there
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if not dead[end] and (not out or fits(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            token = shorter[token]
            while token < 0:  # nothing fits here: shorten the token before
                dead[at] = 1
                last = out.pop()
                at -= length[last]
                token = shorter[last]

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.splits is None or not self.splits.search(text):
            return b"".join(map(self.known.__getitem__, self.pieces.findall(text)))
        out = []
        for part in self.splits.split(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out.extend(map(self.known.__getitem__, self.pieces.findall(part)))
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        """The text of packed ids; bytes that are not UTF-8 become U+FFFD."""
        if not ids:
            return ""
        a = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        starts, sizes = self.offsets[a], self.offsets[a + 1] - self.offsets[a]
        ends = np.cumsum(sizes)
        index = np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])
        return self.block[index].tobytes().decode("utf-8", "replace")


class _Known(dict):
    """Encodings of pieces met before, made when first asked for.

    When it is full it becomes the old generation, and what is still asked for moves over from there:
    so at most twice ``MEMORY`` pieces are held, and frequent ones stay.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.old = vocabulary, {}
        self.packed = [i.to_bytes(4, "little") for i in range(len(vocabulary.bytes_of))]

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = b"".join(map(self.packed.__getitem__, self.vocabulary.encode_piece(piece.encode("utf-8"))))
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        if len(piece) < 64:
            self[piece] = out
        return out


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(raw: bytes) -> Vocabulary:
    """The tables, made once in each worker process."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(raw)
    return _loaded[key]


def encode_decode(df: DataFrame, tokenizer_file: str, text: str = "text", decode: bool = True) -> DataFrame:
    """``df`` with ``n_tokens`` long, ``ids`` binary (little-endian unsigned 32-bit
    integers) and, if asked for, ``decoded`` string.

    The vocabulary file (1.5 MB, of fixed size) is read on the driver and broadcast.
    """
    with open(tokenizer_file, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    fields += [T.StructField("decoded", T.StringType())] * decode
    out = append_columns(df, fields)
    kept = [f.name for f in out.fields[: len(out.fields) - len(fields)]]

    def run(batches):
        vocabulary = _vocabulary(raw.value)
        for whole in batches:
            for batch in slices(whole, text):
                ids = [vocabulary.encode(x) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                arrays += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decode:
                    arrays.append(pa.array([vocabulary.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in out.fields])

    return df.mapInArrow(tidy(run, "bpe", _loaded.clear), out)
