"""Byte-pair encoding of whole corpora with a public vocabulary of ranks.

The merges of one batch of texts are found together. All different pretokens of the batch that were not
met before lie one after another in one linked list of symbols; an index maps each rank to the positions
at which a pair with that rank stands. Active ranks are applied in ascending order, leftmost position
first, and each merge updates the lists of the two pairs beside it. The result equals encoding each
pretoken by itself, as merges never cross a pretoken's end.
"""

from __future__ import annotations

import base64
import heapq
import importlib.util
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship

# The pattern that splits text before the merges; a fixed value that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: So many known pretokens a worker keeps, each of at most ``KEEP_CHARS`` characters; then it starts afresh.
KEEP, KEEP_CHARS = 200_000, 64


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a public vocabulary file lies: in the folder ``PUBLIC_TOKENIZERS``, else in the installed package."""
    at = os.environ.get("PUBLIC_TOKENIZERS")
    if not at:
        spec = importlib.util.find_spec("public_tokenizers")
        at = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(at, name)


class PairIndexEncoder:
    """Encodes texts with the ranks of a vocabulary file (lines of base64 bytes and a rank)."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        self.split = regex.compile(PATTERN).findall
        self.byte_ids = [self.ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _pair_rank(self, a: int, b: int) -> int:
        """The rank of two symbols' pair, -1 if it never merges."""
        r = self.pairs.get((a, b))
        if r is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            r = self.pairs[a, b] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return r

    def merge_all(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word, from one index of pair positions over all of them."""
        out: list[tuple[int, ...] | None] = [None] * len(words)
        sym: list[int] = []
        starts: list[int] = []
        byte_ids, ranks, pair_rank = self.byte_ids, self.ranks, self._pair_rank
        for k, w in enumerate(words):
            raw = w.encode("utf-8", "surrogatepass")
            whole = ranks.get(raw)
            if whole is not None:
                out[k] = (whole,)
                starts.append(-1)
                continue
            starts.append(len(sym))
            sym.extend([byte_ids[b] for b in raw])
            sym.append(-1)  # ends the word
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for i in range(n - 1):
            a, b = sym[i], sym[i + 1]
            if a >= 0 and b >= 0 and (r := pair_rank(a, b)) >= 0:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for at, i in enumerate(places):
                a = sym[i]
                if a < 0:
                    continue
                j = nxt[i]
                b = sym[j]
                if b < 0 or pair_rank(a, b) != rank:
                    continue
                sym[i], sym[j] = rank, -2  # -2: taken into the symbol before it
                k = nxt[j]
                nxt[i] = k
                prv[k] = i
                lower = False
                p = prv[i]
                if p >= 0 and sym[p] >= 0 and (r := pair_rank(sym[p], rank)) >= 0:
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        heapq.heappush(heap, r)
                    lower = r < rank
                c = sym[k]
                if c >= 0 and (r := pair_rank(rank, c)) >= 0:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                        heapq.heappush(heap, r)
                    lower = lower or r < rank
                if lower:  # a pair with a lower rank came up: it goes first
                    index.setdefault(rank, []).extend(places[at + 1 :])
                    heapq.heappush(heap, rank)
                    break
        for k, i in enumerate(starts):
            if i >= 0:
                ids = []
                while sym[i] >= 0:
                    ids.append(sym[i])
                    i = nxt[i]
                out[k] = tuple(ids)
        return out  # type: ignore[return-value]

    def encode_batch(self, texts: Iterable[str | None]) -> list[list[int]]:
        """The ids of each text; none for an empty or null text."""
        known = self.known
        if len(known) > KEEP:
            known.clear()
        split = [self.split(t) if t else [] for t in texts]
        new = list({w for ws in split for w in ws if w not in known})
        table = known
        if new:
            found = dict(zip(new, self.merge_all(new)))
            known.update((w, v) for w, v in found.items() if len(w) <= KEEP_CHARS)
            if any(len(w) > KEEP_CHARS for w in new):
                table = known | found
        return [[i for w in ws for i in table[w]] for ws in split]


_ENCODERS: dict[str, PairIndexEncoder] = {}


def encoder(path: str) -> PairIndexEncoder:
    """The worker's encoder for a vocabulary file; it stays while the worker does."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PairIndexEncoder(path)
    return _ENCODERS[path]


#: Texts of about so many characters are encoded together.
BATCH_CHARS = 4_000_000


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= BATCH_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, key: str, text: str, vocabulary: str | None = None, counts_only: bool = False) -> DataFrame:
    """``key`` and the token ids of ``text`` (``ids``), or with ``counts_only`` their number (``n_tokens``).

    Row by row: nothing is shuffled, and repeated rows are encoded as often as they stand there. A null or
    empty text has an empty list (0 tokens); whole texts are encoded, whatever their length; strings that
    look like special tokens are ordinary text. An empty table gives an empty result, and further columns
    are dropped, whatever their names.
    """
    path = vocabulary or vocabulary_path()
    ship(df.sparkSession)
    kind = df.schema[key].dataType
    rows = df.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _groups(texts):
                ids = enc.encode_batch(texts[lo:hi])
                if counts_only:
                    last = pa.array([len(x) for x in ids], pa.int64())
                else:
                    last = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), last], [key, "n_tokens" if counts_only else "ids"])

    out = f"`{key}` {kind.simpleString()}, " + ("n_tokens bigint" if counts_only else "ids array<int>")
    return rows.mapInArrow(run, out)
