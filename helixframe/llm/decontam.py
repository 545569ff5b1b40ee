"""Benchmark decontamination by templates.

Words are lower-cased; numbers, units after numbers and names (capitalised words inside a sentence) become typed
placeholders.  A capitalised word that opens a sentence has two forms, literal and name.  Windows of 8 template words are
looked up among those of the benchmark by hash, on three levels: with opening words literal, in either form, and with all words
literal, so that what stands verbatim is found in any context and however many numbers it has.  Matches of one document
and item on one diagonal form an alignment; it counts if it has as many windows as a passage of 13 words (all, for a
shorter item), and if its slots are consistent: equal benchmark values stand for equal document values.  Where one clashes,
only the windows without a slot of that value count; a verbatim stretch of VERBATIM words counts whatever clashes elsewhere.
So verbatim passages and re-parameterised questions are both found, and a chance template is not.

The benchmark is read in blocks of at most BLOCK_CHARS characters, each broadcast and matched in one pass over the documents;
there is no limit on its size.

Defined results: null and empty texts match nothing; items under 5 template words are not searched for; items of 5 to 7
words are one window of their own length; template windows with fewer literals than placeholders (with opening words as names:
with less than a third literal) are passed over, literal windows are not; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import Scan, mix, slices
from .workers import returning

WINDOW, PASSAGE, SHORTEST, VERBATIM = 8, 13, 5, 26
BLOCK_CHARS = 8_000_000
#: Units (fixed values).
UNITS = "mg g kg t mm cm m km in ft mi ml l s sec min h hr hrs hour hours day days week weeks month months year years percent pct usd eur gbp dollar dollars euro euros cent cents mile miles foot feet inch inches meter meters metre metres gram grams liter liters litre litres w kw v hz k c f".split()

_U = np.uint64
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_WORD = _DIGIT.copy()
_WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?:\n\"("]] = True
_NUMBER, _UNIT, _NAME = (_U(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))


def _inside(buf: np.ndarray) -> np.ndarray:
    """Letters and digits, and a point or comma between digits."""
    out = _WORD[buf]
    if len(buf) > 2:
        digit = _DIGIT[buf]
        out[1:-1] |= ((buf[1:-1] == 46) | (buf[1:-1] == 44)) & digit[:-2] & digit[2:]
    return out


def _upper(buf: np.ndarray) -> np.ndarray:
    """Where a capital letter begins: ASCII, or Latin-1 in UTF-8."""
    out = (buf >= 65) & (buf <= 90)
    if len(buf) > 1:
        out[:-1] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    return out


def _fold(buf: np.ndarray) -> np.ndarray:
    out = buf.copy()
    cap = _upper(buf)
    out[cap & (buf < 128)] += 32
    wide = np.flatnonzero(cap & (buf == 0xC3)) + 1
    out[wide] += 32
    return out


class Template(Scan):
    """Words with their template hashes (form) and, for placeholders, what stands there (value)."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts, _inside, _fold)
        n = len(self.starts)
        self.value = self.words
        number = _DIGIT[self.buf[self.starts]] if n else np.zeros(0, bool)
        stops = np.concatenate([[0], np.cumsum(_STOP[self.buf])])
        first = np.zeros(n, dtype=bool)
        first[self.ptr[:-1][np.diff(self.ptr) > 0]] = True
        gap = np.ones(n, dtype=bool)
        gap[1:] = stops[self.starts[1:]] > stops[self.ends[:-1]]
        cap = _upper(self.raw)
        after = np.minimum(self.starts + 1 + (self.raw[self.starts] == 0xC3), self.ends - 1) if n else self.starts
        capital = cap[self.starts] & (self.ends - self.starts > 1) & ~cap[after] & ~number if n else number
        name = capital & ~first & ~gap
        unit = np.zeros(n, dtype=bool)
        if n > 1:
            unit[1:] = number[:-1] & (self.starts[1:] - self.ends[:-1] <= 1) & ~first[1:] & np.isin(self.value[1:], unit_hashes())
        self.slot = number | name | unit
        self.form = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, self.value)))
        self.opening = capital & ~self.slot
        self.loose = self.slot | self.opening

    def opened(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        """(form, slot) with opening words as names: the odd ones if which has bit 1, the even ones if it has bit 2."""
        odd = np.cumsum(self.opening) & 1 == 1
        names = self.opening & np.where(odd, bool(which & 1), bool(which & 2))
        return np.where(names, _NAME, self.form), self.slot | names

    def template_windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the windows of k words of which at least half are literal."""
        return self.windows(k, self.form, self.slot, -(-k // 2))

    def opened_windows(self, k: int, which: int) -> tuple[np.ndarray, np.ndarray]:
        return self.windows(k, *self.opened(which), -(-k // (3 if k == WINDOW else 2)))

    def literal_windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.windows(k, self.value, np.zeros(len(self.value), dtype=bool), 0)

    def windows(self, k: int, form: np.ndarray, slot: np.ndarray, literals: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the windows of k words of which so many are literal."""
        n = len(form) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            h *= _U(0xD6E8FEB86659FD93)
            h += form[j : j + n]
        slots = np.concatenate([[0], np.cumsum(slot)])
        end = np.repeat(self.ptr[1:], np.diff(self.ptr))
        at = np.flatnonzero((np.arange(n) + k <= end[:n]) & (slots[k:] - slots[:-k] <= k - literals))
        return at, mix(h[at])


_UNIT_HASHES: np.ndarray | None = None


def unit_hashes() -> np.ndarray:
    global _UNIT_HASHES
    if _UNIT_HASHES is None:
        _UNIT_HASHES = np.sort(Scan(pa.array(UNITS), _inside, _fold).words)
    return _UNIT_HASHES


class Table:
    """Windows of a block of benchmark items by hash."""

    def __init__(self, h: np.ndarray, at: np.ndarray, own: np.ndarray, n_items: int):
        order = np.lexsort((at, h))
        h, at, own = h[order], at[order], own[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (np.diff(at) != 0) | (h[1:] != h[:-1])
        self.hash, self.at, self.item = h[new], at[new], own[new]
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.hash >> _U(44)).astype(np.int64)] = True
        starts = np.unique(np.stack([own, at], axis=1), axis=0)[:, 0] if len(own) else own
        self.windows = np.bincount(starts, minlength=n_items)

    def find(self, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the document, entry) of every window that is in the table."""
        likely = np.flatnonzero(self.maybe[(h >> _U(44)).astype(np.int64)])
        at, h = at[likely], h[likely]
        lo, hi = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, side="right")
        count = hi - lo
        return np.repeat(at, count), np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


class Index:
    """The three tables of windows of a block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = np.array(ids, dtype=np.int64)
        t = Template(pa.array(texts, pa.string()))
        self.ptr, self.value = t.ptr, t.value
        self.slots = t.slot, t.loose, t.loose
        size = np.diff(t.ptr)
        self.lengths = sorted({WINDOW, *(int(k) for k in size[(size >= SHORTEST) & (size < WINDOW)])})
        kinds = [[t.template_windows], [t.template_windows, *(lambda k, w=w: t.opened_windows(k, w) for w in (1, 2, 3))], [t.literal_windows]]
        self.tables = []
        for kind in kinds:
            hashes, words, owners = [], [], []
            for k in self.lengths:
                for windows in kind:
                    at, h = windows(k)
                    own = np.searchsorted(t.ptr, at, side="right") - 1
                    ok = (size[own] == k) if k < WINDOW else np.ones(len(at), dtype=bool)
                    hashes.append(h[ok])
                    words.append(at[ok])
                    owners.append(own[ok])
            self.tables.append(Table(*(np.concatenate(x) for x in (hashes, words, owners)), len(ids)))

    def consistent(self, level: int, i: int, at: np.ndarray, value: np.ndarray, diag: int) -> tuple[int, bool] | None:
        """(windows, verbatim) of the part of an alignment that has no clash, if it is large enough; at is where the windows begin."""
        k = min(WINDOW, int(self.ptr[i + 1] - self.ptr[i]))
        inside = at[:, None] + np.arange(k)
        words = np.unique(inside)
        slot, least = self.slots[level], min(PASSAGE - WINDOW + 1, self.tables[level].windows[i])
        if len(at) < least:
            return None
        slots = words[slot[words]]
        pairs = {}
        for theirs, ours in zip(self.value[slots].tolist(), value[slots + diag].tolist(), strict=True):
            pairs.setdefault(theirs, set()).add(ours)
        clashing = np.array([v for v, ours in pairs.items() if len(ours) > 1], dtype=np.uint64)
        if len(clashing):
            bad = slot[inside] & np.isin(self.value[inside], clashing)
            free = at[~bad.any(axis=1)]
            if len(free) < least:
                same = at[(self.value[inside] == value[inside + diag]).all(axis=1)]
                runs = np.split(same, np.flatnonzero(np.diff(same) > WINDOW) + 1)
                free = max(runs, key=lambda run: run[-1] - run[0] if len(run) else -1)
                if not len(free) or free[-1] - free[0] + k < VERBATIM:
                    return None
            at = free
        inside = at[:, None] + np.arange(k)
        return len(at), bool((self.value[inside] == value[inside + diag]).all())

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int, bool]]:
        """(text, item id, matched windows, windows of the item, verbatim) of every consistent alignment's best."""
        t = Template(texts)
        best: dict[tuple[int, int], tuple[int, bool]] = {}
        hits = [[], [], [], []]
        for level, table in enumerate(self.tables):
            for k in self.lengths:
                lookups = [t.template_windows(k)] if level == 0 else [t.template_windows(k), t.opened_windows(k, 3)] if level == 1 else [t.literal_windows(k)]
                for at, h in lookups:
                    pos, entry = table.find(at, h)
                    for x, more in zip(hits, (np.searchsorted(t.ptr, pos, side="right") - 1, table.item[entry], table.at[entry], pos), strict=True):
                        x.append(more)
            doc, item, iat, pos = (np.concatenate(x) for x in hits)
            if not len(pos):
                continue
            order = np.lexsort((iat, pos - iat, item, doc))
            doc, item, iat, pos = doc[order], item[order], iat[order], pos[order]
            diag = pos - iat
            cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(diag) != 0)) + 1
            for a, z in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(doc)]]), strict=True):
                i = item[a]
                if z - a < min(PASSAGE - WINDOW + 1, table.windows[i]):
                    continue
                found = self.consistent(level, i, np.unique(iat[a:z]), t.value, int(diag[a]))
                if found:
                    key = (int(doc[a]), int(i))
                    best[key] = max(best.get(key, (0, False)), found)
        return [(d, int(self.ids[i]), n, int(self.tables[-1].windows[i]), same) for (d, i), (n, same) in best.items()]


SCHEMA = "doc_id long, item_id long, n_windows long, item_windows long, verbatim boolean"


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark's items in blocks that fit the driver and a broadcast, one at a time."""
    items = benchmark.selectExpr("cast(item_id as long) item_id", "text").where("item_id is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS) or 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect() if n > 1 else items.collect()
        rows.sort(key=lambda r: (r["item_id"], r["text"]))
        yield Index([r["item_id"] for r in rows], [r["text"] for r in rows])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and item_id of every passage of benchmark(item_id, text) in docs(doc_id, text), with how much of it matched."""
    out = None
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in slices(batches, "text"):
                found = index.matches(b.column(1))
                if found:
                    d, i, n, m, same = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(same)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        got = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(returning(run), SCHEMA)
        out = got if out is None else out.unionByName(got)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no passage of the benchmark, with their columns unchanged."""
    at = docs.columns.index("text")
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in slices(batches, "text"):
                keep = np.ones(b.num_rows, dtype=bool)
                keep[[m[0] for m in index.matches(b.column(at))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(returning(run), docs.schema)
    return docs
