"""Byte-level BPE encoding and decoding by tree reduction: halves are encoded, neighbours joined through growing windows."""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from array import array
from collections.abc import Callable
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.functions.grouped import append

#: Characters of a text that are a leaf of the tree, and bytes of a match; whatever is longer is halved.
TEXT_LEAF, LEAF = 512, 48
#: Matches at the end of a part that what follows it may change: none of the pattern's looks beyond its next but one.
LOOK = 2
#: Ids whose bytes are a leaf of the tree of decoding.
IDS = 4096
#: Matches whose ids a worker remembers, at most.
MEMO = 600_000
INF = 1 << 60
_IDS, _NAMED = itemgetter(1), itemgetter(2)
#: Ids are below it.
WIDE = 1 << 24


class Vocabulary:
    """Ranks of tokens, which are their ids, and the tokens of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        inverse = {v: k for k, v in ranks.items()}
        if len(inverse) < len(ranks) or max(inverse, default=0) >= WIDE:
            raise ValueError(f"ranks have to be different and below {WIDE}")
        self.tokens = [inverse.get(i) for i in range(max(inverse, default=-1) + 1)]
        self.names = [f" {i}" for i in range(len(self.tokens))]
        self.single = [ranks.get(bytes([i])) for i in range(256)]
        if None in self.single:
            raise ValueError("a byte has no rank")
        #: the token of two neighbours, by both of their ids in one number
        self.merged = {ranks[k[:i]] * WIDE + ranks[k[i:]]: v for k, v in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks}

    def merge_all(self, data: bytes) -> list[int]:
        """The ids of data: the neighbours whose token has the lowest rank, leftmost first, are merged until none have one."""
        single, get = self.single, self.merged.get
        ids = [single[x] for x in data]
        if len(ids) > 256:
            return self.merge_long(ids)
        pairs = [get(a * WIDE + b, INF) for a, b in zip(ids, ids[1:], strict=False)]
        while pairs and (low := min(pairs)) < INF:
            i = pairs.index(low)
            ids[i] = low
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(ids[i - 1] * WIDE + low, INF)
            if i < len(pairs):
                pairs[i] = get(low * WIDE + ids[i + 1], INF)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """merge_all() of many bytes: a heap of pairs over a linked list of ids."""
        n, get = len(ids), self.merged.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] * WIDE + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            # a pair that has changed since is passed over
            if ids[i] < 0 or (j := after[i]) >= n or get(ids[i] * WIDE + ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = end = after[j]
            if end < n:
                before[end] = i
            for k in (before[i], i):
                if k >= 0 and (m := after[k]) < n and (r := get(ids[k] * WIDE + ids[m])) is not None:
                    heapq.heappush(heap, (r, k))
        return [x for x in ids if x >= 0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of the bytes of left and right together, which are the ids of their own bytes.

        Where every token of a vocabulary encodes to itself, a list of tokens is the encoding of its bytes exactly if each
        neighbouring pair is the encoding of that pair's bytes. So a window about the border that is encoded anew settles the
        whole as soon as its outermost token on either side is the one that stood there: all pairs outside are then as before.
        """
        if not left or not right:
            return left + right
        a = b = 1
        while True:
            window = self.merge_all(self.bytes(left[-a:] + right[:b]))
            fits_left, fits_right = a >= len(left) or window[0] == left[-a], b >= len(right) or window[-1] == right[b - 1]
            if fits_left and fits_right:
                return left[:-a] + window + right[b:]
            if not fits_left:
                a = min(2 * a, len(left))
            if not fits_right:
                b = min(2 * b, len(right))

    def match(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern: halves are encoded and joined, up the tree."""
        if len(data) <= LEAF:
            return self.merge_all(data)
        half = len(data) // 2
        return self.join(self.match(data[:half]), self.match(data[half:]))

    def bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, concatenated up the tree. KeyError: an id that the vocabulary lacks."""
        if len(ids) <= IDS:
            try:
                if ids and min(ids) < 0:
                    raise IndexError
                return b"".join([self.tokens[i] for i in ids])
            except (IndexError, TypeError):
                raise KeyError("an id that the vocabulary lacks") from None
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class Encoder(dict):
    """Texts to ids by one vocabulary and pattern; as a dict, what it remembers: match -> (match, ids, ids in decimal with a blank before each).

    A part of a text is the list of its matches, each with its ids, as the pattern finds them in that part alone. Two parts
    are joined by matching a window about the border anew: from LOOK matches before it, since no match but the last LOOK of a
    part depends on what follows the part, to where a match of the window ends at the end of one of the right part. From
    there on the pattern meets the characters it met in the right part, so that all later matches stay. A match that the
    window makes of whole old ones takes their ids, joined in turn; others are encoded anew.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, memo: int = MEMO):
        super().__init__()
        self.vocabulary, self.memo, self.older = vocabulary, memo // 2, {}
        self.find = regex.compile(pattern).findall
        self.joins = 0  #: how often parts of a text were joined

    def entry(self, match: str, ids: list[int]) -> tuple[str, list[int], str]:
        return match, ids, "".join([self.vocabulary.names[i] for i in ids])

    def __missing__(self, match: str) -> tuple[str, list[int], str]:
        found = self.older.get(match)
        if found is None:
            found = self.entry(match, self.vocabulary.match(match.encode()))
            if len(match) > LEAF:
                return found
        if len(self) >= self.memo:
            # what has been used since the last time stays
            self.older = self.copy()
            self.clear()
        self[match] = found
        return found

    def join(self, left: list, right: list) -> list:
        """The matches of two neighbouring parts together. left may be changed."""
        self.joins += 1
        if len(left) >= LOOK and len(right) > LOOK + 2:
            # nearly always the border stands within the last match or after it, and all else stays
            x, y = left[-2][0], left[-1][0]
            z = right[0][0]
            window = self.find(f"{x}{y}{z}{right[1][0]}{right[2][0]}{right[3][0]}")
            if len(window) > LOOK + 1:
                end = len(window[0]) + len(window[1]) - len(x) - len(y)
                if not end and window[0] == x:
                    left += right
                    return left
                if end == len(z) and len(window[1]) <= LEAF and window[0] == x:
                    left[-1] = self[window[1]]
                    left += right[1:]
                    return left
        old = left[-LOOK:]
        before = "".join([x[0] for x in old])
        b = 2
        while True:
            b = min(2 * b, len(right))
            ends, at = {}, len(before)
            for i in range(b):
                at += len(right[i][0])
                ends[at] = i + 1
            window = self.find(before + "".join([x[0] for x in right[:b]]))
            # the last matches of the window may depend on what follows it
            sure = len(window) if b == len(right) else len(window) - LOOK
            at, new, place = 0, [], 0
            for x in window[:sure]:
                new.append(x)
                at += len(x)
                if at in ends:
                    place = ends[at]
                    break
            if place or b == len(right):
                break
        place = place or len(right)
        left[-LOOK:] = self.rebuilt(new, old + right[:place])
        left += right[place:]
        return left

    def rebuilt(self, matches: list[str], old: list) -> list:
        """The matches with their ids; a long one that is made of whole old matches takes theirs."""
        out, at, i, begin = [], 0, 0, 0
        for x in matches:
            end = at + len(x)
            while i < len(old) and begin < at:
                begin += len(old[i][0])
                i += 1
            if len(x) <= LEAF or begin != at:
                out.append(self[x])
            else:
                ids, j, stop = None, i, begin
                while j < len(old) and stop < end:
                    stop += len(old[j][0])
                    ids = old[j][1] if ids is None else self.vocabulary.join(ids, old[j][1])
                    j += 1
                out.append(self.entry(x, ids) if stop == end else self[x])
            at = end
        return out

    def matches(self, text: str) -> list:
        """The matches of a text with their ids: its halves are matched and encoded, then joined."""
        leaves = -(-len(text) // TEXT_LEAF)
        if leaves < 2:
            return list(map(self.__getitem__, self.find(text)))
        half = (leaves + 1) // 2 * TEXT_LEAF
        return self.join(self.matches(text[:half]), self.matches(text[half:]))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(_IDS, self.matches(text))))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


_sent: dict[tuple[str, str], Broadcast] = {}


def _ship(docs: DataFrame, ranks: dict[bytes, int]) -> tuple[Broadcast, str]:
    """The vocabulary, whose size is fixed, to every executor, once in a session; and its digest."""
    context = docs.sparkSession.sparkContext
    mark = hashlib.sha256(b"".join(b"%d %d " % (r, len(k)) + k for k, r in sorted(ranks.items()))).hexdigest()
    if (context.applicationId, mark) not in _sent:
        _sent.clear()
        _sent[context.applicationId, mark] = context.broadcast(ranks)
    return _sent[context.applicationId, mark], mark


_worker: dict[str, object] = {}


def _encoder(sent: Broadcast, mark: str, pattern: str) -> Encoder:
    """This worker's only encoder: a table a worker, whatever it is used for."""
    key = mark + pattern
    if key not in _worker:
        _worker.clear()
        _worker[key] = Encoder(Vocabulary(sent.value), pattern)
    return _worker[key]


def _with(docs: DataFrame, ranks: dict[bytes, int], pattern: str, column: str, added: T.StructType, f: Callable[[Encoder, pa.Array], list[pa.Array]], drop: tuple[str, ...] = ()) -> DataFrame:
    sent, mark = _ship(docs, ranks)

    def run(values: pa.Array) -> list[pa.Array]:
        encoder = _encoder(sent, mark, pattern)
        # what is remembered has no cycles, and would be looked through for them again and again
        gc.disable()
        try:
            return f(encoder, values)
        finally:
            gc.enable()

    return append(docs, column, added, run, drop)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """docs without text and with its ids, array<int>; a column that is called like out gives way.

    Null text counts as empty: no ids. Rows are encoded one by one, whole, so that ids may be null or repeat. Empty table: no rows.
    """

    def ids(e: Encoder, column: pa.Array) -> list[pa.Array]:
        # one text at a time: ids take far more room as Python's numbers than as the text
        flat, ends = array("i"), array("i", [0])
        for t in column:
            flat.extend(e.encode(t.as_py() or ""))
            ends.append(len(flat))
        return [pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))]

    return _with(docs, ranks, pattern, text, T.StructType([T.StructField(out, T.ArrayType(T.IntegerType()))]), ids, (text,))


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """tokens with the bytes of its ids, binary, concatenated up the tree; a column that is called like out gives way.

    Null ids count as none: no bytes. A row with an id that is null or that the vocabulary lacks has null bytes. Empty table: no rows.
    """

    def back(e: Encoder, column: pa.Array) -> list[pa.Array]:
        found: list[bytes | None] = []
        for x in column:
            try:
                found.append(e.vocabulary.decode(x.as_py() or []))
            except KeyError:
                found.append(None)
        return [pa.array(found, pa.binary())]

    return _with(tokens, ranks, "", ids, T.StructType([T.StructField(out, T.BinaryType())]), back)


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: ids there and bytes back in one pass.

    Null text counts as empty. Rows are taken one by one, so that ids may be null or repeat. Empty table: no rows.
    """

    def both(e: Encoder, column: pa.Array) -> list[pa.Array]:
        n, there, back = [], [], []
        for t in column:
            found = e.matches(t.as_py() or "")
            ids = list(chain.from_iterable(map(_IDS, found)))
            n.append(len(ids))
            there.append(hashlib.sha256("".join(map(_NAMED, found))[1:].encode()).hexdigest())
            back.append(hashlib.sha256(e.vocabulary.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(there, pa.string()), pa.array(back, pa.string())]

    added = T.StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return _with(docs.select("doc_id", "text"), ranks, pattern, "text", added, both, ("text",))
