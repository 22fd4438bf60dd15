"""Best-fit packing by sums of squares.

Documents become token ids, an end id is appended, and pieces of at most ``capacity`` ids are placed
in sequences. Each piece goes where the sum over all residual gaps of the squared number of open
sequences with that gap becomes smallest: into an open sequence, or into a new one. Ties take the
smallest gap that fits.

Shards of whole documents are packed independently. Their number follows the token count, so that a
shard holds about ``shard_sequences`` sequences; what a shard can lose is its few unfilled last ones.

Defined results: null and empty texts are one piece holding the end id; equal texts and repeated rows
are packed as often as they occur; a null id is packed like any other; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import id_and_text, text_slices
from seqloom.session import materialize

CAPACITY = 4096
END_ID = 1
SHARD_SEQUENCES = 8192
CACHE_WORDS = 600_000  # bound of a worker's memory of encoded words; beyond it, that memory starts anew
SLICE_BYTES = 4 << 20  # of text that is cut into words at a time
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
PLACED = PIECES + ", sequence_id long, offset long"

_LAST_MARK = re.compile(r"(?<=[a-z])([.,])(?=[ \n]|$)")
_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of a text as 4-byte little-endian numbers, one encoding for each distinct word.

    Texts are cut at blanks and line feeds: the tokenizer drops them, and no token or special string
    spans one. They are also cut between a letter and a single full stop or comma that ends a part, as
    letters and marks never share a token. So the ids of the parts, joined, are the ids of the text.
    ASCII texts are lower-cased at once, as the tokenizer does, unless they might hold a special string.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {"": b""}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids that close a unit
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    @staticmethod
    def cut(text: str) -> list[str]:
        if text.isascii() and "<|" not in text:
            text = text.lower()
        return _LAST_MARK.sub(r" \1", text).replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.cut(t) for t in texts]
        new = list(set().union(*split).difference(self.known)) if split else []
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = {"": b""}
            new = list(set().union(*split) - {""})
        letters = [w for w in new if w.isalpha()]
        self._add_letters(letters)
        self._add([w for w in new if w not in self.known])
        code = self.known.__getitem__
        return [b"".join(map(code, ws)) for ws in split]

    def _add(self, words: list[str]) -> None:
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(part, found))

    def _add_letters(self, words: list[str], group: int = 256) -> None:
        """Words of letters only, many in one call: each is one unit, whose last id is marked as an end.

        A group with another number of ends than words (rare letters fall apart in lower case) is left.
        """
        groups = [words[at : at + group] for at in range(0, len(words), group)]
        for at in range(0, len(groups), 256):
            some = groups[at : at + 256]
            found = self.tokenizer.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False)
            for part, code in zip(some, found):
                ids = np.array(code.ids, dtype="<u4")
                cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
                if len(cuts) == len(part):
                    raw, starts = ids.tobytes(), [0, *cuts[:-1].tolist()]
                    self.known.update((w, raw[i:j]) for w, i, j in zip(part, starts, cuts.tolist()))


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document; only documents above ``capacity`` ids are cut."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        width = 4 * capacity
        for ids, texts in text_slices(batches, SLICE_BYTES):
            out: list[list[int | None]] = [[], [], [], [], []]
            for doc_id, code in zip(ids, enc.encode(texts)):
                code += end
                for k in range(0, len(code), width):
                    piece = code[k : k + width]
                    row = (doc_id, k // width, k // 4, len(piece) // 4, zlib.crc32(piece))
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECES)], schema=_PIECES)

    return id_and_text(docs).mapInArrow(cut, PIECES)


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, placed in the given order."""
    open_bins = np.zeros(capacity + 1, dtype=np.int64)  # by residual gap
    stacks: dict[int, list[int]] = {}
    seq, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    made = 0
    for i, size in enumerate(lengths.tolist()):
        best = None
        if size < capacity:
            # change of the sum when a gap h becomes h - size; a gap of 0 is closed and not counted
            left = open_bins[: capacity - size]
            gaps = open_bins[size:capacity]
            change = 2 * (left - gaps) + 2
            change[0] -= 1 + 2 * left[0]
            change[gaps == 0] = np.iinfo(np.int64).max
            at = int(change.argmin()) if len(change) else 0
            if len(change) and gaps[at] and change[at] <= 2 * open_bins[capacity - size] + 1:
                best = at + size
        if best is None:
            best, bin_id = capacity, made
            made += 1
        else:
            bin_id = stacks[best].pop()
            open_bins[best] -= 1
        seq[i], offset[i] = bin_id, capacity - best
        if best > size:
            open_bins[best - size] += 1
            stacks.setdefault(best - size, []).append(bin_id)
    return seq, offset


def pack(cut: DataFrame, capacity: int = CAPACITY, shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """Place written pieces (see :func:`pieces`) in sequences."""
    total = cut.agg(F.sum("length")).first()[0] or 0  # one row
    shards = max(1, -(-int(total) // (capacity * shard_sequences)))
    salted = cut.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))

    def fill(rows: pa.Table) -> pa.Table:
        # The longest first: what is short then finds the gaps that remain.
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        rows = rows.sort_by(order)
        seq, offset = place(rows["length"].to_numpy(), capacity)
        base = rows["_shard"][0].as_py() << 32
        kept = rows.drop_columns(["_shard"])
        return kept.append_column("sequence_id", pa.array(seq + base)).append_column("offset", pa.array(offset))

    return salted.groupBy("_shard").applyInArrow(fill, PLACED)


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(materialize(pieces(docs, tokenizer), "pieces"))
