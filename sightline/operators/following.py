"""What follows objects and texts through time: state machines that the batch and the stream forms share.

Both see observations in order of time and hold only what a later one can still join, so rows may pass by in any amount.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import numpy as np


def dominant_pairs(scores: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-to-one pairs (row, column) of an allowed score matrix, best first; equal scores by row, then column.

    A pair that is the best of its row and of its column is in every such choice, so all of those are taken at once, round by
    round, until no allowed pair is left.
    """
    row, column = np.nonzero(allowed)
    if len(row) < 2:
        return row, column
    order = np.argsort(-scores[row, column], kind="stable")
    row, column = row[order], column[order]
    rows, columns = [row[:0]], [column[:0]]
    while len(row):
        best = np.zeros(len(row), np.int8)
        for side in (row, column):
            best[np.unique(side, return_index=True)[1]] += 1
        taken = best == 2
        rows.append(row[taken])
        columns.append(column[taken])
        left = ~np.isin(row, row[taken]) & ~np.isin(column, column[taken])
        row, column = row[left], column[left]
    return np.concatenate(rows), np.concatenate(columns)


class BoxRules(NamedTuple):
    """A box joins a track that it overlaps by ``overlap`` or whose centre is within ``reach``, at most ``gap`` seconds later."""

    overlap: float = 0.3
    reach: float = 0.15
    gap: float = 1.5

    def checked(self) -> BoxRules:
        if not 0 <= self.overlap <= 1 or self.reach <= 0 or self.gap <= 0:
            raise ValueError("thresholds must be positive, and the overlap at most one")
        return self


def measured(boxes: np.ndarray) -> np.ndarray:
    """Boxes (n x 4) with their centres and areas."""
    sides = np.maximum(0.0, boxes[:, 2:] - boxes[:, :2])
    return np.column_stack([boxes, (boxes[:, :2] + boxes[:, 2:]) / 2, sides[:, 0] * sides[:, 1]])


class BoxTracks:
    """The live tracks of one class in one video, by number: number and time last seen of each, and its measured box."""

    def __init__(self, rules: BoxRules, live: Iterable[Sequence[float]] = (), made: int = 0) -> None:
        self.rules, self.made = rules, made
        known = np.array(list(live), float).reshape(-1, 6)
        self.seen, self.boxes = known[:, :2], measured(known[:, 2:])

    def rows(self) -> list[list[float]]:
        """What another instance can go on from."""
        return np.column_stack([self.seen, self.boxes[:, :4]]).tolist()

    def expire(self, time: float) -> None:
        keep = time - self.seen[:, 1] <= self.rules.gap
        if not keep.all():
            self.seen, self.boxes = self.seen[keep], self.boxes[keep]

    def frame(self, time: float, boxes: np.ndarray) -> np.ndarray:
        """The track numbers of a frame's measured boxes, in their order; what joins no track begins one."""
        self.expire(time)
        numbers = np.full(len(boxes), -1, np.int64)
        if len(self.seen):
            t, i = dominant_pairs(*self._scores(boxes))
            numbers[i] = self.seen[t, 0]
            self.seen[t, 1], self.boxes[t] = time, boxes[i]
        fresh = np.flatnonzero(numbers < 0)
        if len(fresh):
            numbers[fresh] = np.arange(self.made, self.made + len(fresh))
            self.made += len(fresh)
            self.seen = np.concatenate([self.seen, np.column_stack([numbers[fresh], np.full(len(fresh), time)])])
            self.boxes = np.concatenate([self.boxes, boxes[fresh]])
        return numbers

    def _scores(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.boxes[:, None], boxes[None]
        sides = np.maximum(0.0, np.minimum(a[..., 2:4], b[..., 2:4]) - np.maximum(a[..., :2], b[..., :2]))
        shared = sides[..., 0] * sides[..., 1]
        union = b[..., 6] + a[..., 6] - shared
        overlap = np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)
        x, y = b[..., 4] - a[..., 4], b[..., 5] - a[..., 5]
        apart = np.sqrt(x * x + y * y)
        return overlap + 0.25 * np.maximum(0.0, 1.0 - apart / self.rules.reach), (overlap >= self.rules.overlap) | (apart <= self.rules.reach)


class AnchoredTracks:
    """Persons of one video, some with an annotated name: that fixes their track, any other joins a live track by overlap.

    Names are kept for good, so that an annotated person who comes back has the old place among equals; tracks without a
    name are dropped once nothing can join them.
    """

    def __init__(self, overlap: float = 0.3, gap: float = 2.1) -> None:
        self.overlap, self.gap, self.made = overlap, gap, 0
        #: Track -> time last seen and measured box, in the order of their beginnings.
        self.known: dict[str | int, tuple[float, np.ndarray]] = {}

    def frame(self, time: float, names: Sequence[str | None], boxes: np.ndarray) -> list[str | int]:
        """For each person of a frame, in order: the given name, or a number. A track takes one person without a name a frame, and none after its own."""
        self.known = {t: k for t, k in self.known.items() if isinstance(t, str) or time - k[0] <= self.gap}
        live = [t for t, k in self.known.items() if time - k[0] <= self.gap]
        place = {t: i for i, t in enumerate(live)}
        shared = self._overlaps(np.array([self.known[t][1] for t in live]), boxes) if live else np.zeros((0, len(boxes)))
        out: list[str | int] = []
        for i, name in enumerate(names):
            if name is None:
                best = int(shared[:, i].argmax()) if live else -1
                if live and shared[best, i] >= self.overlap:
                    name = live[best]
                else:
                    name, self.made = self.made, self.made + 1
            if name in place:
                shared[place[name]] = -1.0
            self.known[name] = (time, boxes[i])
            out.append(name)
        return out

    @staticmethod
    def _overlaps(tracks: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        a, b = tracks[:, None], boxes[None]
        sides = np.maximum(0.0, np.minimum(a[..., 2:4], b[..., 2:4]) - np.maximum(a[..., :2], b[..., :2]))
        both = sides[..., 0] * sides[..., 1]
        union = a[..., 6] + b[..., 6] - both
        return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


# -- texts -------------------------------------------------------------------------------------------------------------------


def indel_similarity(a: str, b: str) -> float:
    """2 * (longest common subsequence) / (length of both): 1 minus the normalised insert-delete distance. Bit-parallel."""
    if not a and not b:
        return 1.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = state = (1 << len(a)) - 1
    for c in b:
        hit = state & places.get(c, 0)
        state = (state + hit) | (state - hit)
    common = len(a) - (state & full).bit_count()
    return 2 * common / (len(a) + len(b))


def may_share(a: str, b: str, common: int) -> bool:
    """False only if the longest common subsequence is shorter than ``common``.

    As indel_similarity, left early: with ``common`` shared, what b's start shares lies in a's start and what a may lose, and b's
    start misses no more than b may lose.
    """
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    state = (1 << len(a)) - 1
    lost_a, lost_b = len(a) - common, len(b) - common
    for j, c in enumerate(b, 1):
        hit = state & places.get(c, 0)
        state = (state + hit) | (state - hit)
        if not j & 31:
            width = min(len(a), j + lost_a)
            if width - (state & (1 << width) - 1).bit_count() < j - lost_b:
                return False
    return True


#: Bits of a text's signature.
SIGNATURE_BITS = 4096


def signatures(texts: Sequence[str]) -> list[int]:
    """For each text a set of bits, one for every trigram it holds."""
    out = []
    for at in range(0, len(texts), 256):
        part = texts[at : at + 256]
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        bits = np.zeros((len(part), SIGNATURE_BITS), bool)
        if len(codes) > 2:
            h = (codes[:-2] * np.uint64(0x9E3779B1) ^ codes[1:-1] * np.uint64(0x85EBCA77) ^ codes[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x27D4EB2F165667C5)
            owner = np.repeat(np.arange(len(part)), lengths)
            whole = owner[:-2] == owner[2:]
            bits[owner[:-2][whole], (h >> np.uint64(52)).astype(np.int64)[whole]] = True
        out += [int.from_bytes(x.tobytes(), "little") for x in np.packbits(bits, 1)]
    return out


class Reading(NamedTuple):
    """A text as it was first read, and when it was seen."""

    text: str
    signature: int
    start: float
    last: float
    total: float
    count: int


class TextTracks:
    """The texts on the screen of one video that a reading can still join: those seen at most ``gap`` seconds before."""

    def __init__(self, gap: float, similarity: float, live: Iterable[Reading] = ()) -> None:
        self.gap, self.similarity, self.live = gap, similarity, list(live)

    def expired(self, time: float) -> list[Reading]:
        """Drops and returns what nothing from ``time`` on can join."""
        gone = [r for r in self.live if time - r.last > self.gap]
        if gone:
            self.live = [r for r in self.live if time - r.last <= self.gap]
        return gone

    def read(self, time: float, text: str, signature: int, confidence: float) -> None:
        """A reading joins the text that began last of those it is similar to; else it begins one."""
        for at in range(len(self.live) - 1, -1, -1):
            r = self.live[at]
            if self._alike(text, signature, r.text, r.signature):
                self.live[at] = r._replace(last=time, total=r.total + confidence, count=r.count + 1)
                return
        self.live.append(Reading(text, signature, time, time, confidence, 1))

    def _alike(self, a: str, sa: int, b: str, sb: int) -> bool:
        """indel_similarity(a, b) >= similarity, for most pairs by bounds alone.

        The shorter text bounds the common part; and a character taken out ends three trigrams at most, one put in two, so no more
        of a text's bits can be missing in the other's.
        """
        if a == b:
            return True
        both = len(a) + len(b)
        if 2 * min(len(a), len(b)) < self.similarity * both - 1e-6:
            return False
        common = math.ceil(self.similarity * both / 2 - 1e-6)
        lost_a, lost_b = len(a) - common, len(b) - common
        if (sa & ~sb).bit_count() > 3 * lost_a + 2 * lost_b or (sb & ~sa).bit_count() > 3 * lost_b + 2 * lost_a:
            return False
        return may_share(a, b, common) and indel_similarity(a, b) >= self.similarity
