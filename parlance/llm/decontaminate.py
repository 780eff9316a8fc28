"""Benchmark decontamination by pigeonhole edit matching.

Test items and documents are lower-cased with each run of white space as one
space. An item may differ from its copy by a ``1 / EDIT_SHARE`` of its length in
edits; cut into one piece more than that budget, at least one piece of a copy is
untouched (pigeonhole). An automaton finds all exact piece hits of a whole
document in one scan; each hit names the window where its item could lie, and
Myers' bit-parallel recurrence measures the item's least edit distance there.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_back, saved, slices

EDIT_SHARE, GROUP_BYTES = 12, 32 << 20
_WORDS = re.compile(r"\S+")
_MATCHES = "doc_id long, item_id long, distance int, budget int, start long, stop long"


def normalised(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):                          # a few capitals lower to two characters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return " ".join(low.split())


def edit_budget(length: int) -> int:
    return length // EDIT_SHARE


def pieces_of(item: str) -> list[tuple[int, str]]:
    """(offset, text) of budget + 1 pieces of nearly one length."""
    parts = edit_budget(len(item)) + 1
    cuts = [i * len(item) // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class MyersPattern:
    """Least edit distance of a pattern to any substring, a text character a step:
    bit i of the two words says whether the column of distances rises or falls
    between i and i + 1."""

    def __init__(self, pattern: str):
        self.length = len(pattern)
        self.where: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.where[c] = self.where.get(c, 0) | 1 << i

    def search(self, text: str) -> tuple[int, int]:
        """(distance, end) of the best substring of ``text``, the first if equal."""
        full, top = (1 << self.length) - 1, 1 << (self.length - 1)
        rises, falls, here = full, 0, self.length
        best, end = self.length, 0
        for j, c in enumerate(text):
            eq = self.where.get(c, 0)
            diagonal = (((eq & rises) + rises) ^ rises) | eq | falls
            up = falls | (full & ~(diagonal | rises))
            down = rises & diagonal
            if up & top:
                here += 1
            elif down & top:
                here -= 1
            up, down = (up << 1) & full, (down << 1) & full
            rises = down | (full & ~(diagonal | up))
            falls = up & diagonal
            if here < best:
                best, end = here, j + 1
        return best, end

    @staticmethod
    def span(pattern: str, text: str, end: int) -> int:
        """Where the best substring that ends at ``end`` begins: the same search
        backwards, held to the distance already found."""
        back = MyersPattern(pattern[::-1]).search(text[:end][::-1])
        return end - back[1]


class ItemMatcher:
    """The pieces of a bounded group of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(i, t) for i, t in items if t]
        self.budgets = [edit_budget(len(t)) for _, t in self.items]
        self.patterns: dict[int, MyersPattern] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(self.items):
            for at, piece in pieces_of(text):
                places.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def matches(self, raw: str):
        """(item_id, distance, budget, start, stop) of each item within its budget
        of some passage; start and stop count the code points of the raw text."""
        if not self.items or not raw:
            return
        text = normalised(raw)
        windows: dict[int, list[int]] = {}
        for last, (length, found) in self.automaton.iter(text):
            for k, at in found:
                windows.setdefault(k, []).append(last + 1 - length - at)
        starts = None
        for k, begins in windows.items():
            (item_id, item), budget = self.items[k], self.budgets[k]
            best = self._verify(k, item, budget, text, sorted(set(begins)))
            if best:
                distance, a, b = best
                if starts is None:
                    starts = self._raw_places(raw)
                yield item_id, distance, budget, *self._raw_span(starts, a, b)

    def _verify(self, k: int, item: str, budget: int, text: str, begins: list[int]):
        at = text.find(item)
        if at >= 0:
            return 0, at, at + len(item)
        if budget == 0:
            return None
        if k not in self.patterns:
            self.patterns[k] = MyersPattern(item)
        best, i = None, 0
        while i < len(begins):                          # windows that overlap are searched as one
            lo, hi = begins[i] - budget, begins[i] + len(item) + budget
            i += 1
            while i < len(begins) and begins[i] - budget <= hi:
                hi = begins[i] + len(item) + budget
                i += 1
            lo = max(0, lo)
            window = text[lo:hi]
            distance, end = self.patterns[k].search(window)
            if distance <= budget and (best is None or distance < best[0]):
                best = distance, lo + MyersPattern.span(item, window, end), lo + end
        return best

    @staticmethod
    def _raw_places(raw: str) -> tuple[list[int], list[int]]:
        """Where each word begins in the normalised and in the raw text."""
        ours, theirs, at = [], [], 0
        for m in _WORDS.finditer(raw):
            ours.append(at)
            theirs.append(m.start())
            at += len(m[0]) + 1
        return ours, theirs

    @staticmethod
    def _raw_span(places, a: int, b: int) -> tuple[int, int]:
        from bisect import bisect_right

        def raw(x):
            i = max(0, bisect_right(places[0], x) - 1)
            return places[1][i] + x - places[0][i]

        return raw(a), raw(b - 1) + 1 if b > a else raw(a)


def find_contaminated(docs: DataFrame, benchmark: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Which documents hold which benchmark items within their edit budget:
    ``doc_id, item_id, distance, budget, start, stop`` (the best passage of each).

    Null or empty texts match nothing, nor do empty items; items of equal text are
    all reported, also those of null id; repeated document rows give their matches
    each; other columns are not read; empty tables give no rows. Items go out in
    groups of at most ``group_bytes`` (their size is summed first), each scanned
    over all documents.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for shared in _shared_items(benchmark, group_bytes):
        matches = docs.mapInArrow(_matcher(shared), _MATCHES)
        found = matches if found is None else found.unionByName(matches)
    return found


def without_contaminated(docs: DataFrame, benchmark: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text holds no item within its
    edit budget: ids play no part. The rows left by a group of items are written
    before the next, so that a worker holds one group."""
    last = None
    for shared in _shared_items(benchmark, group_bytes):
        if last is not None:
            docs = saved(last, "clean")
        last = docs.mapInArrow(_cleaner(shared, docs.columns.index("text")), docs.schema)
    return last


def _shared_items(benchmark: DataFrame, group_bytes: int):
    """Groups of (item_id, normalised text), broadcast one by one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("length(text) > 0")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    groups = max(1, -(-size * 2 // group_bytes))
    for g in range(groups):
        part = items if groups == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        yield benchmark.sparkSession.sparkContext.broadcast(sorted(((r.item_id, normalised(r.text)) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))


def _cleaner(shared, text: int):
    def clean(batches):
        import pyarrow as pa

        matcher = ItemMatcher(shared.value)
        for batch in slices(batches):
            yield batch.filter(pa.array([next(matcher.matches(t), None) is None for t in batch.column(text).to_pylist()], pa.bool_()))
        matcher = None
        hand_back()

    return clean


def _matcher(shared):
    def scan(batches):
        import pyarrow as pa

        matcher = ItemMatcher(shared.value)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in _MATCHES.split(", ")]
        for batch in slices(batches):
            rows = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in matcher.matches(text)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return scan
