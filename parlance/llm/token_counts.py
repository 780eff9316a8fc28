"""Token counts by two look-ups, both map-side.

A document is cut into pre-tokens that no vocabulary piece crosses, so its count
is the sum of theirs. Tier one is a table of the commonest pre-tokens' counts,
broadcast (``FREQUENT`` entries at most, each at most ``LONGEST`` characters);
what it lacks is encoded once per worker and kept in a bounded memo. No pre-token
is ever shuffled: each task sends only its ``PER_TASK`` commonest to the tally.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _Memo, slices, vocabulary_path

FREQUENT, PER_TASK, LONGEST, TALLY, MEMO = 65_536, 4_096, 64, 200_000, 600_000
_SPACE = "▁"                         # fixed value: the vocabulary's mark for a space
_UNITS = re.compile(f"[ {_SPACE}]*[^ {_SPACE}\n]+|\n|[ {_SPACE}]+")


class PieceCounter:
    """Token counts of whole texts, as the sentencepiece library gives them."""

    def __init__(self, path: str, table: dict | None = None):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        # cutting is exact where no piece has a space mark after another character
        # or a line feed beside others, and the library only turns spaces to marks
        # and puts one in front
        self.memo = _Memo(self._encode, MEMO)
        self.lead = len(self.library.encode("\n"))
        probe = " \n\t a   \u3000ﬁＡé  \n b "
        self.exact = (not any(re.search(f"[^{_SPACE}]{_SPACE}", p) or ("\n" in p and p != "\n") for p in pieces)
                      and self.library.decode(self.library.encode(probe)) == probe
                      and sum(map(self._encode, self.units(probe))) == len(self.library.encode(probe)))
        self.table = table or {}

    def _encode(self, unit: str) -> int:
        """The count of a unit with just the spaces it begins with: the one that
        the library puts in front is held off by a line feed."""
        return len(self.library.encode("\n" + unit)) - self.lead

    def units(self, text: str) -> list[str]:
        return _UNITS.findall(" " + text) if text else []

    def count(self, text: str) -> int:
        if not self.exact:
            return len(self.library.encode(text))
        table, memo = self.table, self.memo
        return sum([table.get(u) or memo[u] for u in self.units(text)])


_COUNTERS: dict = {}


def _counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def frequent_units(docs: DataFrame, vocabulary: str, most: int = FREQUENT) -> dict[str, int]:
    """The commonest pre-tokens of all texts with their token counts. Tasks keep
    bounded tallies (the rarer half goes when one is full), so the choice is
    near, not exact; the counts of what it holds are exact."""

    def tally(batches):
        from collections import Counter

        import pyarrow as pa

        counter, seen = _counter(vocabulary), Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(counter.units(text))
            if len(seen) > TALLY:
                seen = Counter(dict(seen.most_common(TALLY // 2)))
        top = [(u, n) for u, n in seen.most_common(PER_TASK) if len(u) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["unit", "n"])

    tallies = docs.select("text").mapInArrow(tally, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    counter = PieceCounter(vocabulary)
    return {r.unit: counter.memo[r.unit] for r in tallies.orderBy(F.desc("n"), "unit").limit(most).collect()}


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row.

    Null text counts as empty (0 bytes, 0 tokens); repeated rows give a row each;
    a null ``doc_id`` stays null; other columns are not read; an empty table gives
    no rows. Special strings inside texts are ordinary text, the library's default.
    """
    vocabulary = vocabulary or vocabulary_path("piece_bpe_32k.model")
    docs = docs.select("doc_id", "text")
    table = docs.sparkSession.sparkContext.broadcast(frequent_units(docs, vocabulary))

    def count(batches):
        import pyarrow as pa

        counter = _counter(vocabulary)
        counter.table = table.value
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                pa.array([counter.count(t) for t in texts], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
