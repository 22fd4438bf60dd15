"""BPE encoding by depth-first traversal of a trie of distinct words, and decoding.

A byte sequence has exactly one encoding, and so has each of its prefixes. The encoding of a prefix is
known from its last token alone: dropping that token leaves the encoding of a shorter prefix. The last
token of a prefix is the one vocabulary entry that ends it and may follow the last token of the prefix
before it, where "may follow" means that merging the two tokens' bytes gives back the two tokens.
The distinct words of a slice of texts form a trie whose depth-first order is their sorted order: the
state of a shared prefix, its last token, is computed once and stays on the stack for all words below.

Defined results: null and empty texts have no tokens and the digests of the empty string; the special
token's own string becomes its id, as in the library; long texts and long words are encoded whole;
repeated rows are repeated; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from seqloom.llm.common import id_and_text, text_slices

# Fixed value: the published pattern that cuts text into words before byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Bounds of what a worker remembers between slices; beyond one, that memory starts anew.
CACHE_PARTS = 500_000
CACHE_WORDS = 500_000
CACHE_PAIRS = 1_000_000


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return table | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        alphabet = _byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        vocab, special = data["model"]["vocab"], {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of = {i: as_bytes(t) for t, i in vocab.items() if t not in special}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.decode_table = self.bytes_of | {i: t.encode() for t, i in special.items()}
        self.special = special
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
        #: the merged token's rank; a token's own rank is that of the merge that makes it, bytes have none
        self.rank_of_pair: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank_of_pair[left, right] = rank
            self.made.setdefault(whole, (rank, left, right))
        lengths: dict[bytes, set[int]] = {}
        for token in self.id_of:
            lengths.setdefault(token[-2:], set()).add(len(token))
        self.lengths = {k: sorted(v | {1}, reverse=True) for k, v in lengths.items() if len(k) == 2}
        self.words = regex.compile(PATTERN)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[tuple[int, ...], str]] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens, merged as one sequence, give these two tokens.

        Undo merges from the border outwards, the latest one first. The two are merged wrongly if the
        pair that then meets at the border has a merge that comes before the one undone last; at equal
        rank the pair further left comes first.
        """
        key = (left, right)
        if key in self.pairs:
            return self.pairs[key]
        none = (-1, -1, -1)
        limit, left_first = len(self.made) + len(self.rank_of_pair) + 1, False
        good = True
        while True:
            rank = self.rank_of_pair.get((left, right))
            if rank is not None and (rank < limit or rank == limit and left_first):
                good = False
                break
            a, b = self.made.get(left, none), self.made.get(right, none)
            if a[0] < 0 and b[0] < 0:
                break
            if a[0] > b[0]:
                # inside the left token the merge lies further left than the border: it wins a tie
                limit, left_first, left = a[0], False, a[2]
            else:
                limit, left_first, right = b[0], True, b[1]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def last_token(self, word: bytes, end: int, states: list[int]) -> int:
        """The last token of ``word[:end]``; ``states[i]`` is that of ``word[:i]``."""
        id_of = self.id_of
        for size in self.lengths.get(word[end - 2 : end], (1,)) if end > 1 else (1,):
            if size <= end:
                token = id_of.get(word[end - size : end])
                if token is not None and (size == end or self.may_follow(states[end - size], token)):
                    return token
        raise ValueError("the vocabulary lacks a single byte")

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Ids of each distinct word, in the depth-first order of their trie."""
        out: dict[bytes, tuple[int, ...]] = {}
        states: list[int] = [-1]  # the stack: states[i] belongs to the node at depth i of the current path
        before = b""
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                states.append(self.last_token(word, end, states))
            ids, end = [], len(word)
            while end:
                ids.append(states[end])
                end -= len(self.bytes_of[states[end]])
            out[word] = tuple(reversed(ids))
            before = word
        return out

    def _pieces(self, part: str) -> list[str]:
        """Words and special strings of a part of a text."""
        if self.cut_special is None or not any(s in part for s in self.special):
            return self.words.findall(part)
        return [w for p in self.cut_special.split(part) if p for w in ([p] if p in self.special else self.words.findall(p))]

    @staticmethod
    def _parts(text: str) -> list[str]:
        """Cut a text where words end anyway, so that parts recur: before a blank or line feed that follows
        another character than white space, and, without runs of white space, around line feeds and
        before a full stop or comma that ends a part."""
        if "\0" in text or _SPACE_PAIR.search(text):
            return _CUT.split(text)
        return _LAST_MARK.sub("\0\\1", text).replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str]) -> list[list[tuple[tuple[int, ...], str]]]:
        """For each text its parts' ids, also as decimal text."""
        split = [self._parts(t) if t else [] for t in texts]
        wanted = set().union(*split) if split else set()
        new = wanted.difference(self.parts)
        if len(self.parts) + len(new) > CACHE_PARTS:
            self.parts.clear()
            new = wanted
        if new:
            cut = {part: self._pieces(part) for part in new}
            found = self._words(set(chain.from_iterable(cut.values())))
            for part, ws in cut.items():
                ids = tuple(chain.from_iterable([found[w] for w in ws]))
                self.parts[part] = ids, ",".join(map(str, ids))
        parts = self.parts
        return [[parts[p] for p in ps] for ps in split]

    def _words(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """A mapping that holds at least the ids of these words; special strings are words of their own."""
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known = {}
        if not self.known:
            self.known = {w: (i,) for w, i in self.special.items()}
        coded = {w.encode("utf-8"): w for w in words.difference(self.known)}
        self.known.update((coded[raw], ids) for raw, ids in self.encode_words(coded).items())
        return self.known

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.decode_table.__getitem__, ids)).decode("utf-8", "replace")


_SPACE_PAIR = re.compile(r"\s\s")
_LAST_MARK = re.compile(r"(?<=[a-z])([.,])(?=[ \n]|$)")
_CUT = regex.compile(r"(?<=\S)(?=[ \n])", flags=regex.V1)
_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary, read once per worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Per document ``n_tokens``, the digests of ids and of the decoded text; ``ids`` if asked for."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for doc_ids, texts in text_slices(batches):
            rows = []
            for doc_id, parts in zip(doc_ids, bpe.encode(texts)):
                ids = list(chain.from_iterable([p[0] for p in parts]))
                written = ",".join([p[1] for p in parts if p[1]])
                back = bpe.decode(ids)
                row = (doc_id, len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
                rows.append(row + (ids,) * with_ids)
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return id_and_text(docs).mapInArrow(run, ddl)
