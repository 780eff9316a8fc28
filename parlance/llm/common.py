"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import re

from pyspark.sql import DataFrame, SparkSession

WORD_SPACE = "\t\n\x0b\x0c\r "          # what separates words: 0x20 and 0x09-0x0D


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str) -> str:
    """Where the public vocabulary file ``name`` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: the
    lineage ends at committed files, so a lost executor costs no upstream work."""
    from ..session import scratch_path

    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = 256):
    """Arrow batches cut to a few hundred rows, so that Python never holds the
    texts of a whole 10,000-row batch as objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def hand_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and
    the next stage's share is counted beside what they keep."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+`` as UTF-8. bytes.lower changes
    A-Z only and bytes.split cuts at exactly those six characters."""
    return text.encode("utf-8").lower().split() if text else []


# ----------------------------------------------------------------------------
# byte-level BPE through caches

# fixed values: the split of the byte-level vocabulary, spelt out for texts below
# U+0250 with the letters and numbers that lie there
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_PRETOKENS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
# Python's \s also takes the four separators U+001C..1F, the library's does not;
# classes of characters from U+0250 on are left to the library, but for the
# commonest marks (dashes, quotes, bullets, the euro sign)
_LIBRARY_ONLY = re.compile("[\x1c-\x1f\u0250-\u200f\u2028-\u20ab\u20ad-\U0010ffff]")


def _byte_symbols() -> list[str]:
    """Byte-level BPE's printable stand-in for every byte."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (chr(256 + n) for n in range(256))
    return [chr(b) if b in kept else next(rest) for b in range(256)]


class _Memo(dict):
    """A bounded memo: ``memo[key]`` computes what it lacks; it starts afresh
    when full, so a worker's memory does not follow the vocabulary."""

    def __init__(self, fn, most: int):
        super().__init__()
        self.fn, self.most = fn, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.fn(key)
        return value


class BpeEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    The library's model tokenizes each different pre-token once per worker; texts
    are joined from that memo. Texts holding a special string, or a character on
    whose class Python and the library could differ, go to the library whole, as
    do all texts when the vocabulary file is not a plain byte-level BPE.
    ``plain_specials`` reads special strings as ordinary text.
    """

    MEMO = 1_000_000

    def __init__(self, path: str, plain_specials: bool = False):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.joined = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                       and not pre.get("add_prefix_space") and model.get("type") == "BPE"
                       and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")))
        added = spec.get("added_tokens") or []
        self.specials = [t["content"] for t in added if not (plain_specials and t.get("special"))]
        self.size = max([*model["vocab"].values(), *(t["id"] for t in added)]) + 1
        self._symbols = dict(enumerate(_byte_symbols()))
        self._model = self.tokenizer.model
        self._bytes = [i.to_bytes(4, "little") for i in range(self.size)]
        self._memo = _Memo(self._pretoken, self.MEMO)

    def _whole(self, text: str) -> bytes:
        return b"".join([self._bytes[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _pretoken(self, token: str) -> bytes:
        symbols = token.encode("utf-8").decode("latin-1").translate(self._symbols)
        return b"".join([self._bytes[t.id] for t in self._model.tokenize(symbols)])

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.joined or _LIBRARY_ONLY.search(text) or any(s in text for s in self.specials):
            return self._whole(text)
        return b"".join(map(self._memo.__getitem__, _PRETOKENS.findall(text)))


_ENCODERS: dict = {}


def bpe_encoder(path: str, plain_specials: bool = False) -> BpeEncoder:
    """One encoder, with its memos, per Python worker."""
    key = (path, plain_specials)
    if key not in _ENCODERS:
        _ENCODERS[key] = BpeEncoder(*key)
    return _ENCODERS[key]
