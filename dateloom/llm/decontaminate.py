"""Benchmark items found in documents by edit distance: CGK embedding, bit-sampling LSH, exact verification.

Texts are lower-cased and runs of white space become one space. A CGK walk reads a string from a start, writes one
byte a step and moves on by a random bit that depends on the step and the byte; strings within few edits come back
into step with each other, so their walks differ in few places. Walks from every code point of a document, as long as
the item asks, are sampled at a few places; equal samples in any of the repetitions make a candidate, which an exact
bit-parallel edit distance confirms. The repetitions are as many as the target recall asks on edited copies of all
items of a length class. Where REPETITIONS do not reach it, for items that lie below it, and for items beyond
WALKED bytes, places that pass the count of grams are confirmed by edit distance without walks, which misses none.

Which starts walk at all is decided without loss: a window within k edits of an item of m bytes holds at least
m - GRAM + 1 - GRAM * k of the items' grams of GRAM bytes, and of those at places divisible by s so many less
(s - 1) * (k + 1), divided by s, as each of the k + 1 unedited pieces loses s - 1 at most by rounding. One vectorised
pass counts the latter; around what passes all grams are counted, at last for single items, of which so many must also
lie within k places of one diagonal. Items under GRAM bytes allow no edit and are searched as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dateloom.llm import kernels
from dateloom.llm.common import frugal, tune

GRAM = 10
#: Bits of the table of grams; a false hit only lets a start walk.
_TABLE = 23
#: Bytes of text searched at once, and bytes that walks write at once.
_AT_ONCE = 1 << 22
_WRITTEN = 1 << 26
#: Grams hashed at once; strides of the first count and the grams it must ask for; places of a window's grams in an item
#: beyond which diagonals are not counted.
_HASHED, _STRIDES, _ASKED, _DIAGONALS = 1 << 15, (4, 2), 5, 1 << 18
#: Most repetitions, items that a gram is counted for singly (one of more items counts for all), longest item that walks.
REPETITIONS, _OWNERS, WALKED = 256, 64, 4096
#: Edited copies of each item in a trial, and how far one item's share of found copies may lie below the target.
_COPIES, _BELOW = 3, 0.05
_MATCH = "doc_id long, item_id long, distance int, start int, length int"


@dataclass(frozen=True)
class Search:
    """edits: allowed edits as a share of an item's bytes; sampled: places of a walk in a key; walks: random walks;
    recall: target for items with all the edits allowed; block: bytes of items searched in one pass over the documents."""

    edits: float = 0.05
    sampled: int = 6
    walks: int = 8
    recall: float = 0.95
    block: int = 4 << 20
    seed: int = 5

    def allowed(self, size: int) -> int:
        """Edits allowed for an item of so many bytes, as far as the count of grams can bound them."""
        return min(int(self.edits * size), max(0, (size - GRAM) // GRAM))


def normalised(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "replace")


def edit_distance_in(item: bytes, text: bytes, most: int, anchored: bool = False) -> tuple[int, int] | None:
    """(distance, end) of the substring of text nearest to item if within `most` edits; bit-parallel, one step a byte.

    anchored: only substrings from the start of text.
    """
    at = text.find(item)
    if at == 0 or at > 0 and not anchored:
        return 0, at + len(item)
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    up, down, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(horizontal | up))
        minus = up & horizontal
        score += bool(plus & top) - bool(minus & top)
        plus = (plus << 1 | anchored) & full
        minus = (minus << 1) & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
        if score <= most and (best is None or score < best[0]):
            best = score, j + 1
    return best


def _place(item: bytes, text: bytes, most: int) -> tuple[int, int, int] | None:
    """(distance, start, length) of the substring of text nearest to item if within `most` edits."""
    got = edit_distance_in(item, text, most)
    if got is None:
        return None
    distance, end = got
    _, length = edit_distance_in(item[::-1], text[:end][::-1], distance, anchored=True)
    return distance, end - length, length


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of raw as a number; raw has eight bytes or more."""
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(np.ascontiguousarray(raw), (len(raw) - 7, 8), (1, 1))).view("<u8").ravel()


def _grams(raw: np.ndarray, step: int = 1) -> np.ndarray:
    """A hash for each gram of GRAM bytes at the places 0, step, 2 * step, ..."""
    n = max(0, len(raw) - GRAM + step) // step
    out = np.empty(n, np.uint64)
    raw = np.ascontiguousarray(raw)
    with np.errstate(over="ignore"):
        for i in range(0, n, _HASHED):
            h = out[i : i + _HASHED]
            first, last = (np.ndarray(len(h), "<u8", raw, i * step + k, step) for k in (0, GRAM - 8))
            np.add(first * np.uint64(0x9E3779B97F4A7C15), last * np.uint64(0xD6E8FEB86659FD93), out=h)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x7FB5D329728EA185)
    return out


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - _TABLE)).view(np.int64)


def _spans(at: np.ndarray, least: int, before: int, after: int, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the runs of places x with at least `least` of the ascending places `at` from x - before to
    x + after; runs not over gap apart are one."""
    first, last = at[least - 1 :] - after, at[: max(0, len(at) - least + 1)] + before
    some = first <= last
    first, last = first[some], last[some]
    apart = first[1:] > last[:-1] + gap + 1
    ends = np.ones(min(1, len(first)), bool)
    return first[np.concatenate((ends, apart))], last[np.concatenate((apart, ends))]


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each first on, so many as counted, one range after the other."""
    return np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class _Walker:
    """The random walks: for each a bit by step and byte, made anew from the seed wherever a walker arrives."""

    def __init__(self, search: Search, steps: int):
        self.search, self.steps = search, steps
        self.bits = self._drawn()

    def _drawn(self) -> np.ndarray:
        return np.random.Generator(np.random.PCG64(self.search.seed)).integers(0, 2, (self.search.walks, self.steps, 256), dtype=np.uint8)

    def __getstate__(self):
        return self.search, self.steps

    def __setstate__(self, state):
        self.search, self.steps = state
        self.bits = self._drawn()

    def walk(self, which: int, raw: np.ndarray, starts: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Bytes that the walks from starts write, each as many steps as told, most first; raw ends with so many zeros."""
        out = np.empty((int(steps[0]), len(starts)), np.uint8)
        at = starts.copy()
        going = len(starts) - np.searchsorted(steps[::-1], np.arange(len(out)), side="right")
        for j, n in enumerate(going.tolist()):
            out[j, :n] = byte = raw[at[:n]]
            at[:n] += self.bits[which, j][byte]
        return out


class _Owners:
    """Which items of a class hold a gram, as sorted arrays."""

    def __init__(self, items: np.ndarray, grams: list[np.ndarray]):
        self.items = items
        every = np.concatenate(grams)
        local = np.repeat(np.arange(len(items), dtype=np.int32), [len(g) for g in grams])
        order = np.argsort(every, kind="stable")
        self.grams, self.first, counts = np.unique(every[order], return_index=True, return_counts=True)
        self.local, self.counts = local[order], counts.astype(np.int32)

    def counted(self, grams: np.ndarray) -> tuple[int, np.ndarray]:
        """(how many of the grams too many items hold, how many of the others each item holds)."""
        at = np.searchsorted(self.grams, grams)
        at[at == len(self.grams)] = 0
        at = at[self.grams[at] == grams]
        often = self.counts[at] > _OWNERS
        rare = at[~often]
        n = self.counts[rare]
        return int(often.sum()), np.bincount(self.local[_ranges(self.first[rare], n)], minlength=len(self.items))


@dataclass
class _Class:
    """Items of like length: low to high bytes; hits: grams that a window of any of them holds, strided: those of them at
    places divisible by the index's stride; edits: most of any;
    keys: [(walk, places, sorted keys, item numbers)]; sure: numbers of items that are confirmed without walks."""

    low: int
    high: int
    hits: int
    strided: int
    edits: int
    keys: list
    sure: set
    owners: _Owners


class Index:
    """A block of items by length class: samples of their walks, and the grams of all."""

    def __init__(self, items: list[tuple[int, bytes]], search: Search):
        self.search, self.items = search, [(i, t) for i, t in items if len(t) >= GRAM]
        #: by length: (sorted first eight bytes, ids and bytes in that order) of items under GRAM bytes
        self.short = {m: self._by_bytes([(i, t) for i, t in items if len(t) == m], m) for m in sorted({len(t) for _, t in items}) if 0 < m < GRAM}
        sizes = np.array([len(t) for _, t in self.items], np.int64)
        self.longest = int(sizes.max()) if len(sizes) else 0
        self.table = np.zeros(1 << _TABLE, bool)
        self.own = [np.unique(_grams(np.frombuffer(t, np.uint8))) for _, t in self.items]
        self.every = np.unique(np.concatenate(self.own)) if self.items else np.zeros(0, np.uint64)
        self.table[_slots(self.every)] = True
        self.stride = next((s for s in _STRIDES if all(self._least(n, s) >= _ASKED for n in range(len(self.items)))), 1)
        self.walker = _Walker(search, 2 * int(sizes[sizes <= WALKED].max()) if (sizes <= WALKED).any() else 0)
        self.classes: list[_Class] = []
        rng = np.random.Generator(np.random.PCG64(search.seed + 1))
        order = np.argsort(sizes, kind="stable")
        k = 0
        while k < len(order):
            low = int(sizes[order[k]])
            here = order[k : int(np.searchsorted(sizes[order], min(low * 1.2, WALKED) if low <= WALKED else low * 1.2, side="right"))]
            k += len(here)
            hits, strided = (max(1, min(self._least(int(n), s) for n in here)) for s in (1, self.stride))
            found = _Class(low, int(sizes[here].max()), hits, strided, max(search.allowed(int(s)) for s in sizes[here]), [], set(here.tolist()), _Owners(here, [self.own[n] for n in here]))
            self.classes.append(found)
            if low > WALKED:
                continue
            # a walk stays half of its steps: so many read the shortest item of the class once
            steps = 2 * low
            texts = [self.items[n][1] for n in here]
            embedded = self._embedded(texts, steps)
            repetitions, weak = self._repetitions(texts, embedded, steps)
            found.sure = set(here[weak].tolist())
            for r in range(repetitions):
                places = np.sort(rng.choice(steps, search.sampled, replace=False))
                key = self.key(embedded[r % search.walks][places])
                by = np.argsort(key, kind="stable")
                found.keys.append((r % search.walks, places, key[by], here[by]))

    @staticmethod
    def _by_bytes(items: list[tuple[int, bytes]], m: int):
        values = np.array([int.from_bytes(t[:8], "little") for _, t in items], np.uint64)
        by = np.argsort(values, kind="stable")
        return values[by], [items[k] for k in by]

    def _least(self, n: int, step: int = 1) -> int:
        """Grams of item n that any window within its edits holds at places divisible by step."""
        size = len(self.items[n][1])
        edits = self.search.allowed(size)
        return -(((step - 1) * (edits + 1) - (size - GRAM + 1 - GRAM * edits)) // step)

    def _held(self, raw: np.ndarray, begin: int, end: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(places, grams) of what raw holds of the items' grams at each step-th place from begin to end."""
        grams = _grams(raw[begin : end + GRAM - 1], step)
        at = np.flatnonzero(self.table[_slots(grams)])
        grams = grams[at]
        known = self.every[np.minimum(np.searchsorted(self.every, grams), len(self.every) - 1)] == grams
        return at[known] * step + begin, grams[known]

    def _near(self, raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, grams) of the items' grams, all of them wherever the places divisible by stride hold enough for any class."""
        at, grams = self._held(raw, 0, size, self.stride)
        if self.stride == 1:
            return at, grams
        areas = []
        for of in self.classes:
            # with the starts beside those that pass, which may walk as well
            beside = 2 * of.edits + GRAM
            first, last = _spans(at, of.strided, of.edits, of.high + of.edits - 1)
            areas += zip((first - beside - of.edits).tolist(), (last + beside + of.high + 2 * of.edits).tolist())
        found, done = [], 0
        for first, last in sorted(areas):
            begin, end = max(first, done), min(last + 1, len(raw) - GRAM + 1)
            if begin < end:
                found.append(self._held(raw, begin, end))
                done = end
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (at[:0], grams[:0])

    def _starts(self, n: int, at: np.ndarray, grams: np.ndarray, first: int, last: int) -> np.ndarray:
        """Places from first to last whose window may hold item n, by its grams `grams` at the places `at`."""
        item = _grams(np.frombuffer(self.items[n][1], np.uint8))
        order = np.argsort(item, kind="stable")
        begin, end = (np.searchsorted(item[order], grams, side=side) for side in ("left", "right"))
        size, least = len(item) + GRAM - 1, max(1, self._least(n))
        edits = self.search.allowed(size)
        if (end - begin).sum() > _DIAGONALS:
            firsts, lasts = _spans(at[end > begin], least, edits, size + 2 * edits - GRAM)
        else:
            diagonals = np.sort(np.repeat(at, end - begin) - order[_ranges(begin, end - begin)])
            # a copy begins within the edits of so many diagonals; the window of a start holds it from three times the
            # edits before to the edits after
            firsts, lasts = _spans(diagonals, least, edits, edits, 4 * edits)
            firsts, lasts = firsts - 3 * edits, lasts + edits
        return np.concatenate([at[:0], *(np.arange(max(first, a), min(last, b) + 1) for a, b in zip(firsts.tolist(), lasts.tolist()))])

    def _passing(self, of: _Class, grams: np.ndarray) -> list[int]:
        """Items of a class of which places with these grams hold enough."""
        shared, counts = of.owners.counted(grams)
        among = np.arange(len(counts)) if shared >= of.hits else np.flatnonzero(counts)
        return [n for n, c in zip(of.owners.items[among].tolist(), counts[among].tolist()) if c + shared >= self._least(n)]

    def _embedded(self, texts: list[bytes], steps: int) -> list[np.ndarray]:
        apart = b"\0" * steps
        raw = np.frombuffer(apart.join(texts) + apart, np.uint8)
        starts = np.concatenate(([0], np.cumsum([len(t) + steps for t in texts])[:-1])).astype(np.int64)
        return [self.walker.walk(w, raw, starts, np.full(len(starts), steps)) for w in range(self.search.walks)]

    def _repetitions(self, texts: list[bytes], embedded: list[np.ndarray], steps: int) -> tuple[int, np.ndarray]:
        """(repetitions that find a share `recall` of edited copies of all texts, numbers of the texts that lie below it);
        no repetitions and all texts where REPETITIONS do not suffice."""
        rng = np.random.Generator(np.random.PCG64(self.search.seed + len(texts) + steps))
        agree = []
        for _ in range(_COPIES):
            other = self._embedded([_edited(t, self.search.allowed(len(t)), rng) for t in texts], steps)
            agree.append(np.stack([(a == b).mean(axis=0) for a, b in zip(embedded, other)]) ** self.search.sampled)
        agree = np.stack(agree)
        miss, r = np.ones((_COPIES, len(texts))), 0
        while r < 8 or (r < REPETITIONS and 1 - miss.mean() < self.search.recall):
            miss *= 1 - agree[:, r % self.search.walks]
            r += 1
        if 1 - miss.mean() < self.search.recall:
            return 0, np.arange(len(texts))
        return r, np.flatnonzero(1 - miss.mean(axis=0) < self.search.recall - _BELOW)

    @staticmethod
    def key(sampled: np.ndarray) -> np.ndarray:
        out = np.zeros(sampled.shape[1], np.uint64)
        with np.errstate(over="ignore"):
            for written in sampled:
                out = kernels.mix(out + written.astype(np.uint64) + np.uint64(1))
        return out

    def _short(self, texts: list[bytes], raw: np.ndarray, stops: np.ndarray):
        """(text number, item id, 0, start, length) of the first place of each item under GRAM bytes in each text."""
        words = _eights(raw)
        for m, (values, items) in self.short.items():
            mask = np.uint64((1 << 8 * min(m, 8)) - 1)
            known = np.unique(values)
            here = words[: int(stops[-1])] & mask
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, here), len(known) - 1)] == here)
            seen = set()
            for x, t in zip(at.tolist(), np.searchsorted(stops, at).tolist()):
                begin = int(stops[t]) - len(texts[t])
                for k in range(*(int(np.searchsorted(values, here[x], side=side)) for side in ("left", "right"))):
                    if (t, k) not in seen and texts[t].startswith(items[k][1], x - begin):
                        seen.add((t, k))
                        yield t, items[k][0], 0, x - begin, m

    def search_block(self, texts: list[bytes]):
        """(text number, item id, distance, start, length) of each item in each text: its nearest place, the first of equally near ones."""
        stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
        raw = np.frombuffer(b"\0".join(texts) + b"\0" * (2 * self.longest + GRAM), np.uint8)
        if self.short:
            yield from self._short(texts, raw, stops)
        if not self.classes:
            return
        size = int(stops[-1])
        hit_at, hit_grams = self._near(raw, size)
        #: by class: numbers that stand for a start and an item; (text number, item number, first and end byte) to be
        #: confirmed without walks
        walking, direct, many = [], [], len(self.items)
        for of in self.classes:
            pairs = [hit_at[:0]]
            for first, last in zip(*(x.tolist() for x in _spans(hit_at, of.hits, of.edits, of.high + of.edits - 1, GRAM))):
                # runs of starts whose windows overlap, by text
                for t in range(*(np.searchsorted(stops, (max(0, first), min(last, size - 1))) + (0, 1)).tolist()):
                    stop = int(stops[t])
                    start = stop - len(texts[t])
                    a, b = max(first, start), min(last, stop - 1)
                    if a > b:
                        continue
                    begin, end = max(a - of.edits, start), min(b + of.high + 2 * of.edits, stop)
                    here = slice(*np.searchsorted(hit_at, (begin, end)))
                    for n in self._passing(of, hit_grams[here]):
                        if n in of.sure:
                            direct.append((t, n, begin, end))
                        else:
                            pairs.append(self._starts(n, hit_at[here], hit_grams[here], a, b) * many + n)
            pairs = np.unique(np.concatenate(pairs))
            # any code point but a space may begin an item
            byte = raw[pairs // many]
            walking.append(pairs[((byte & 0xC0) != 0x80) & (byte != 32) & (byte != 0)])
        starts = np.unique(np.concatenate(walking) // many)
        need = np.zeros(len(starts), np.int64)
        for of, pairs in zip(self.classes, walking):
            need[np.searchsorted(starts, pairs // many)] = 2 * of.low
        order = np.argsort(-need, kind="stable")
        starts, need = starts[order], need[order]
        i, seen = 0, [hit_at[:0]]
        while i < len(starts):
            # as many starts at once as write a bounded number of bytes
            part = starts[i : i + max(1024, _WRITTEN // (self.search.walks * int(need[i])))]
            walks = [self.walker.walk(w, raw, part, need[i : i + len(part)]) for w in range(self.search.walks)]
            i += len(part)
            for of, pairs in zip(self.classes, walking):
                at = np.flatnonzero(np.isin(part, pairs // many))
                if not len(at):
                    continue
                for which, places, known, items in of.keys:
                    found = self.key(walks[which][np.ix_(places, at)])
                    a, b = np.searchsorted(known, found, side="left"), np.searchsorted(known, found, side="right")
                    x = np.flatnonzero(b > a)
                    seen.append(np.repeat(part[at[x]], (b - a)[x]) * many + items[_ranges(a[x], (b - a)[x])])
        seen = np.intersect1d(np.concatenate(seen), np.concatenate(walking))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for x, n in zip((seen // many).tolist(), (seen % many).tolist()):
            item = self.items[n][1]
            edits = self.search.allowed(len(item))
            t = int(np.searchsorted(stops, x))
            begin = int(stops[t]) - len(texts[t])
            at = x - begin
            a = max(0, at - edits)
            if best.get((t, n), (1,))[0] == 0:
                continue
            got = _place(item, texts[t][a : at + len(item) + 2 * edits], edits)
            if got is not None and (got[0], a + got[1]) < best.get((t, n), (edits + 1, 0)):
                best[t, n] = (got[0], a + got[1], got[2])
        for t, n, a, b in direct:
            begin = int(stops[t]) - len(texts[t])
            got = _place(self.items[n][1], texts[t][a - begin : b - begin], self.search.allowed(len(self.items[n][1])))
            if got is not None and ((t, n) not in best or (got[0], a - begin + got[1]) < best[t, n]):
                best[t, n] = (got[0], a - begin + got[1], got[2])
        for (t, n), (distance, at, length) in best.items():
            yield t, self.items[n][0], distance, at, length


def _edited(text: bytes, edits: int, rng: np.random.Generator) -> bytes:
    """A copy with so many random edits of a byte."""
    b = bytearray(text)
    for _ in range(edits):
        p, letter = int(rng.integers(0, len(b))), int(rng.integers(97, 123))
        kind = rng.integers(0, 3)
        if kind == 0:
            b[p] = letter
        elif kind == 1:
            b.insert(p, letter)
        elif len(b) > 1:
            del b[p]
    return bytes(b)


def _matches(index: Index):
    def run(batches):
        for batch in batches:
            texts = [normalised(t) for t in batch.column("text").to_pylist()]
            ids = batch.column("doc_id").to_pylist()
            rows = []
            off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
            for i, j in kernels.blocks(off, _AT_ONCE):
                rows += [(ids[i + t], item, d, s, max(0, length)) for t, item, d, s, length in index.search_block(texts[i:j])]
            columns = list(zip(*rows)) or [(), (), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "distance", "start", "length"])

    return run


def _blocks(benchmark: DataFrame, most: int):
    """The items, normalised, in blocks of `most` bytes (one longer item is a block of its own)."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    block, size = [], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        text = normalised(row[1])
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((row[0], text))
        size += len(text)
    if block:
        yield block


def contaminated(documents: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """(doc_id, item_id, distance, start, length) of each benchmark item found in each row of documents (doc_id, text).

    distance: edits in bytes; start and length: of the best place in the normalised text. The items are a query set,
    held against all documents in blocks of bounded size, without any shuffle of documents. Items without id or text
    and blank ones are no evidence and found nowhere; equal items are found each. A null or empty text holds nothing;
    rows that repeat a doc_id report each for itself; an empty table on either side gives no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    tune(spark, 1024)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for block in _blocks(benchmark, search.block):
        part = rows.mapInArrow(frugal(_matches(Index(block, search))), _MATCH)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], _MATCH)


def without_contaminated(documents: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """The rows of documents (text, ...) that hold no benchmark item, as they are; judged where they are read.

    A null or empty text holds nothing and stays; rows that repeat are judged each for itself; an empty benchmark
    leaves all rows, an empty table has none. Other columns, of whatever names, are passed on.
    """
    tune(documents.sparkSession, 1024)

    def clean(index: Index):
        def run(batches):
            for batch in batches:
                texts = [normalised(t) for t in batch.column("text").to_pylist()]
                keep = np.ones(len(texts), bool)
                off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
                for i, j in kernels.blocks(off, _AT_ONCE):
                    for t, *_ in index.search_block(texts[i:j]):
                        keep[i + t] = False
                yield batch.filter(pa.array(keep))

        return run

    for block in _blocks(benchmark, search.block):
        documents = documents.mapInArrow(frugal(clean(Index(block, search))), documents.schema)
    return documents
