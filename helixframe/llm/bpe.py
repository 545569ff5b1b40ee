"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list.  Every adjacent pair that is a token waits in the bucket of its merge rank; a
three-level bitmap marks the buckets in use, find-first-set gives the next rank, and an entry whose pair has changed
since is skipped.  A pre-token of n bytes takes O(n log n) steps, however long it is.

Texts are cut at single spaces between two characters that are not white space: a match of the pattern always starts at
such a space, so the pieces can be matched, encoded and kept apart.  The pieces of a batch are told apart in its buffer, only new
ones are matched and encoded, and ids, their decimals and the bytes they decode to are gathered from tables.

Defined results: a null text is an empty one, with 0 tokens, and both digests are those of no bytes.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .textscan import slices, text_buffer
from .workers import returning

#: Pieces whose encoding a Python worker keeps; those beyond are encoded each time they come.
CACHE_SIZE = 500_000
#: So many pieces' ids are gathered at a time.
PIECES = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token, a space, its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. of n[0] numbers, then those of first[1], and so on."""
    end = np.cumsum(n, dtype=np.int64)
    out = np.repeat(first - end + n, n)
    out += np.arange(len(out))
    return out


def spans(ptr: np.ndarray, most: int = PIECES) -> Iterator[tuple[int, int]]:
    """Runs of texts with so many pieces at most, one longer text alone."""
    at = 0
    while at + 1 < len(ptr):
        to = max(at + 1, int(np.searchsorted(ptr, ptr[at] + most, side="right")) - 1)
        yield at, to
        at = to


#: Bytes that may begin a character that is not white space, those of three or two bytes that may begin white space left out.
_AFTER = np.zeros(256, dtype=bool)
_AFTER[0x21:0x80] = _AFTER[0xC3:0xE1] = _AFTER[0xE4:0xF8] = True
_WHITE_3 = np.zeros(256, dtype=bool)
_WHITE_3[[0xE1, 0xE2, 0xE3]] = True


def solid_before(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before a place cannot be white space."""
    last = raw[at - 1]
    return (last > 0x20) & ((last < 0x80) | (raw[np.maximum(at - 2, 0)] != 0xC2) & ~_WHITE_3[raw[np.maximum(at - 3, 0)]])


def cuts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces start: texts, and in them single spaces between characters that are not white space.

    A match starts at every such space; that is right for patterns, such as the one of the public tokenizers, whose matches hold a
    space only as their first character or in a run of white space.
    """
    edge = np.zeros(len(raw) + 2, dtype=bool)
    edge[off] = True
    at = np.flatnonzero(raw == 32)
    at = at[~edge[at] & ~edge[at + 1]]  # neither ends nor begins a text
    edge[at[_AFTER[raw[at + 1]] & solid_before(raw, at)]] = True
    return np.flatnonzero(edge[: len(raw)])


class RankQueue:
    """A queue of (rank, position): lowest rank first, then lowest position."""

    def __init__(self, n_ranks: int):
        self.low = [0] * ((n_ranks >> 6) + 1)
        self.mid = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        own = self.buckets.get(rank)
        if own is not None:
            heapq.heappush(own, at)
            return
        self.buckets[rank] = [at]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def fill(self, rank: int, at: list[int]) -> None:
        """Push positions that are in order at a rank whose bucket is empty."""
        self.push(rank, at[0])
        self.buckets[rank] = at

    def push_many(self, ranks: list[int], at: list[int]) -> None:
        get = self.buckets.get
        for rank, i in zip(ranks, at, strict=True):
            own = get(rank)
            if own is None:
                self.push(rank, i)
            else:
                own.append(i)

    def pop_all(self) -> tuple[int, list[int]] | None:
        """The lowest rank and all that waits there."""
        if not self.top:
            return None
        rank = self._lowest()
        own = self.buckets[rank]
        self._clear(rank)
        return rank, own

    def _lowest(self) -> int:
        a = (self.top & -self.top).bit_length() - 1
        x = self.mid[a]
        b = a << 6 | ((x & -x).bit_length() - 1)
        x = self.low[b]
        return b << 6 | ((x & -x).bit_length() - 1)

    def _clear(self, rank: int) -> None:
        del self.buckets[rank]
        self.low[rank >> 6] &= ~(1 << (rank & 63))
        if not self.low[rank >> 6]:
            self.mid[rank >> 12] &= ~(1 << (rank >> 6 & 63))
            if not self.mid[rank >> 12]:
                self.top &= ~(1 << (rank >> 12))

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        rank = self._lowest()
        own = self.buckets[rank]
        at = heapq.heappop(own)
        if not own:
            self._clear(rank)
        return rank, at


class Codec:
    """Encoder and decoder for one rank file and pre-token pattern."""

    def __init__(self, path: str, pattern: str, cache_size: int = CACHE_SIZE):
        self.ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.find = regex.compile(pattern).findall
        self.queue = RankQueue(max(self.tokens) + 1)
        self.cache_size = cache_size
        self.known = pa.array([], pa.large_binary())  # pieces, and where their ids are
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        in_order = [self.tokens.get(r, b"") for r in range(max(self.tokens) + 1)]
        self.token_size = np.array([len(t) for t in in_order], dtype=np.int32)
        self.token_first = (np.cumsum(self.token_size) - self.token_size).astype(np.int64)
        self.token_bytes = np.frombuffer(b"".join(in_order), dtype=np.uint8)
        self.digits = np.array([b"%d " % r for r in range(len(in_order))])
        self.n_digits = np.char.str_len(self.digits).astype(np.int32)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        joins = [(self.ranks[t[:k]] << 32 | self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.join_keys, self.join_made = np.array(sorted(joins), dtype=np.int64).T.copy()
        b = np.arange(256)
        self.byte_pairs = self.join_rank(np.repeat(self.byte_ids[b], 256), np.tile(self.byte_ids[b], 256)).reshape(256, 256)

    def encode_bytes(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n, get, queue, longest = len(piece), ranks.get, self.queue, self.longest
        push, pop = queue.push, queue.pop
        end = list(range(1, n + 1))  # of the token that starts here
        back = list(range(-1, n))  # where the token before starts; one more for the end
        pair = [-1] * n  # rank of the token that this one and the next would make
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                push(r, i)
        while (got := pop()) is not None:
            r, i = got
            if pair[i] != r:
                continue  # stale
            mid = end[i]
            stop = end[mid]
            end[i] = stop
            pair[mid] = -1
            back[stop] = i
            pair[i] = -1
            if stop < n and end[stop] - i <= longest and (r := get(piece[i : end[stop]])) is not None:
                pair[i] = r
                push(r, i)
            j = back[i]
            if j >= 0:
                pair[j] = -1
                if stop - j <= longest and (r := get(piece[j:stop])) is not None:
                    pair[j] = r
                    push(r, j)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text, each match of the pattern separately."""
        return [x for piece in self.find(text) for x in self.encode_bytes(piece.encode("utf-8", "surrogatepass"))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, how many each has) of many pre-tokens.  The short ones share one linked list and one queue, so that
        all positions that wait at a rank are merged together; of each pre-token only the leftmost is taken at a time, as a merge may
        make a pair of lower rank."""
        whole = np.fromiter(map(self.ranks.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        long = {i: self.encode_bytes(pieces[i]) for i in np.flatnonzero((whole < 0) & (size > 64)).tolist()}
        short = np.flatnonzero((whole < 0) & (size <= 64))
        ids, n_short = self.merge_short([pieces[i] for i in short.tolist()], size[short])
        n = np.ones(len(pieces), dtype=np.int64)
        n[short] = n_short
        n[list(long)] = [len(x) for x in long.values()]
        first = np.cumsum(n) - n
        out = np.empty(int(n.sum()), dtype=np.int32)
        out[first[whole >= 0]] = whole[whole >= 0]
        out[ragged(first[short], n_short)] = ids
        for i, own in long.items():
            out[first[i] : first[i] + len(own)] = own
        return out, n

    def merge_short(self, pieces: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """encode_many for pieces of at most 64 bytes that are no tokens."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n = len(raw)
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        last = np.cumsum(size) - 1
        token = self.byte_ids.astype(np.int32)[raw]
        after = np.arange(1, n + 1, dtype=np.int32)
        after[last] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[last - size + 1] = -1
        pair = np.full(n, -1, dtype=np.int32)
        pair[:-1] = self.byte_pairs[raw[:-1], raw[1:]]
        pair[last] = -1
        dead = np.zeros(n, dtype=bool)
        queue = self.queue
        waiting = np.flatnonzero(pair >= 0)
        waiting = waiting[np.argsort(pair[waiting], kind="stable")]
        ranks, first = np.unique(pair[waiting], return_index=True)
        for r, own in zip(ranks.tolist(), np.split(waiting, first[1:]) if len(ranks) else [], strict=True):
            queue.fill(r, own.tolist())
        while (got := queue.pop_all()) is not None:
            r, own = got
            at = np.array(own)
            at = at[pair[at] == r]  # the others are stale
            if len(at) > 1:
                at = np.sort(at)
                lead = np.ones(len(at), dtype=bool)
                lead[1:] = owner[at[1:]] != owner[at[:-1]]
                if not lead.all():
                    queue.fill(r, at[~lead].tolist())
                    at = at[lead]
            if not len(at):
                continue
            mid = after[at]
            stop = after[mid]
            token[at] = r
            after[at] = stop
            dead[mid] = True
            pair[mid] = -1
            has = stop >= 0
            before[stop[has]] = at[has]
            left = before[at]
            to = left >= 0
            left = left[to]
            place = np.concatenate([at, left])
            made = self.join_rank(np.concatenate([np.full(len(at), r), token[left]]), np.concatenate([np.where(has, token[stop], -1), np.full(len(left), r)]))
            pair[place] = made
            new = made >= 0
            queue.push_many(made[new].tolist(), place[new].tolist())
        return token[~dead], np.bincount(owner[~dead], minlength=len(pieces))

    def join_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs of tokens make; -1 for none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
        return np.where((self.join_keys[at] == key) & (right >= 0), self.join_made[at], -1)

    def matches(self, pieces: pa.Array) -> tuple[list[str], np.ndarray]:
        """(matches of the pattern one after another, how many each piece has).  Pieces that begin and end at cuts are matched in one
        text, since a match begins where the next piece does."""
        raw, off = text_buffer(pieces)
        lo, hi = off[:-1], off[1:]
        inner = (hi - lo > 1) & (raw[lo] == 32)
        inner[inner] = _AFTER[raw[lo[inner] + 1]] & solid_before(raw, hi[inner])
        here = np.flatnonzero(inner)
        if len(here):
            joined = raw[np.repeat(inner, hi - lo)]
            found = self.find(joined.tobytes().decode())
            ends = np.cumsum((joined & 0xC0) != 0x80)[np.cumsum((hi - lo)[here]) - 1]  # in characters
            upto = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            if len(found) and upto[-1] == ends[-1]:
                n = np.zeros(len(pieces), dtype=np.int64)
                n[here] = np.bincount(np.searchsorted(ends, upto), minlength=len(here))
                if len(here) == len(pieces):
                    return found, n
                first = np.cumsum(n[here]) - n[here]
                place = {i: (a, a + k) for i, a, k in zip(here.tolist(), first.tolist(), n[here].tolist(), strict=True)}
                out: list[str] = []
                at = 0
                for i in np.flatnonzero(~inner).tolist():
                    before = int(np.searchsorted(here, i))
                    stop = place[int(here[before - 1])][1] if before else 0
                    out += found[at:stop]
                    own = self.find(pieces[i].as_py().decode())
                    out += own
                    n[i], at = len(own), stop
                return out + found[at:], n
        own = [self.find(p.decode()) for p in pieces.to_pylist()]  # a pattern that skips characters
        return [m for x in own for m in x], np.array([len(x) for x in own], dtype=np.int64)

    def rows_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the table of the pieces one after another, first of each text with the end last); new pieces wait at the table's end
        for learn."""
        raw, off = text_buffer(texts)
        starts = cuts(raw, off)
        ptr = np.searchsorted(starts, off)
        if not len(starts):
            return np.zeros(0, np.int32), ptr
        ends = pa.py_buffer(np.append(starts, len(raw)))
        named = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, ends, pa.py_buffer(raw)]).dictionary_encode()
        row = pc.index_in(named.dictionary, value_set=self.known)
        rows = row.fill_null(-1).to_numpy(zero_copy_only=False).copy()
        if row.null_count:
            held = len(self.known)
            self.known = pa.concat_arrays([self.known, named.dictionary.filter(row.is_null())])
            rows[rows < 0] = np.arange(held, len(self.known))
        return rows[named.indices.to_numpy()], ptr

    def learn(self) -> None:
        """Find the ids of the pieces that wait."""
        if len(self.known) == len(self.first):
            return
        found, n = self.matches(self.known[len(self.first) :])
        place: dict[str, int] = {}
        at = np.fromiter((place.setdefault(m, len(place)) for m in found), np.int64, len(found))
        del found
        pieces = [m.encode() for m in place]
        del place
        ids, size = self.encode_many(pieces)
        first, many = np.cumsum(size) - size, size[at]
        total = np.concatenate([[0], np.cumsum(many)])
        own = np.diff(total[np.concatenate([[0], np.cumsum(n)])])
        self.first = np.append(self.first, len(self.ids) + np.cumsum(own) - own)
        self.size = np.append(self.size, own.astype(np.int32))
        self.ids = np.append(self.ids, ids[ragged(first[at], many)])

    def ids_of(self, rows: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, first of each text with the end last) for what rows_of gave, once learned."""
        n = self.size[rows]
        return self.ids[ragged(self.first[rows], n)], np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[ptr]

    def forget(self) -> None:
        """Keep the first pieces only."""
        if len(self.known) > self.cache_size:
            k, stop = self.cache_size, int(self.first[self.cache_size])
            self.known = pa.concat_arrays([self.known[:k], self.known[:0]])
            self.first, self.size, self.ids = self.first[:k].copy(), self.size[:k].copy(), self.ids[:stop].copy()

    def decimals(self, ids: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, first of each text with the end last): ids as decimals with a space after each."""
        flat = self.digits[ids].view(np.uint8)
        return flat[flat != 0], np.concatenate([[0], np.cumsum(self.n_digits[ids], dtype=np.int64)])[ptr]

    def decode_many(self, ids: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, first of each text with the end last) that ids stand for."""
        n = self.token_size[ids]
        return self.token_bytes[ragged(self.token_first[ids], n)], np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[ptr]

    def buffers(self, texts: list[pa.Array]) -> Iterator[Iterator[tuple[int, memoryview, memoryview]]]:
        """For each array of texts (a null is an empty one), of every text the number of ids, the ids as decimals joined by a space, and
        the decoded bytes.  New pieces of all arrays are encoded together."""
        rows = [self.rows_of(own) for own in texts]
        self.learn()
        for own, ptr in rows:
            yield itertools.chain.from_iterable(self.views(*self.ids_of(own[ptr[a] : ptr[z]], ptr[a : z + 1] - ptr[a])) for a, z in spans(ptr))
        self.forget()

    def views(self, ids: np.ndarray, ptr: np.ndarray) -> Iterator[tuple[int, memoryview, memoryview]]:
        (text, at), (data, to) = self.decimals(ids, ptr), self.decode_many(ids, ptr)
        text, data = memoryview(text), memoryview(data)
        n, at, to = np.diff(ptr).tolist(), at.tolist(), to.tolist()
        for i, k in enumerate(n):
            yield k, text[at[i] : max(at[i], at[i + 1] - 1)], data[to[i] : to[i + 1]]

    def summaries(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """What buffers gives for one array, as text and bytes."""
        for own in self.buffers([pa.array(texts, pa.string())]):
            for n, text, data in own:
                yield n, bytes(text).decode(), bytes(data)


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a Python worker, kept over tasks."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def bpe_round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text) with n_tokens, and digests of the ids and of the bytes that these decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        gc.disable()  # millions of small tuples without cycles
        for b in slices(batches, "text", 1 << 23):
            n, ids, raw = [], [], []
            for part in own.buffers([x.column(1) for x in slices([b], "text")]):
                for count, text, data in part:
                    n.append(count)
                    ids.append(hashlib.sha256(text).hexdigest())
                    raw.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(returning(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text) with the ids themselves: doc_id, ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            ids = [own.encode(value.as_py() or "") for value in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The bytes that encoded(doc_id, ids) stand for: doc_id, data binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(value.as_py() or []) for value in b.column(1)], pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")
