"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a linked list; adjacent pairs wait in a heap by (rank, position).  The lowest pair is popped
again and again, stale entries are skipped, each merge joins two symbols and pushes its new neighbours.  The count is
the initial symbols less the merges; no identifier is made.  Counts of words are kept in a bounded table per worker,
as most words repeat.

Normalisation, splitting and byte symbols follow the vocabulary file: NFC, white space to one space, lower case by
code point, pieces by pattern, byte symbols, a mark on the last symbol of each piece.  Strings of special tokens in a
text count one token each, as the library does by default.  Which code points are letters or numbers, and their lower
case, depends on the edition of Unicode; for chunks beyond the Latin blocks both are asked of the file's own
normaliser and pattern, so counts agree whatever edition Python has.

Defined cases: a null or empty text has 0 tokens; a very long text is counted whole, chunk by chunk; a ``doc_id`` may be
null or repeat; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, claim, require, trim

LIMIT = 2048
VOCABULARY = "word_bpe_49k.json"
#: The first code point after the Latin blocks, on which all editions of Unicode agree.
BEYOND = "\u0250"
#: White space of the vocabulary's patterns.
_SPACE = regex.compile(r"\s+")


def merges_of(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of merges until no adjacent pair has a rank."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    after[-1] = -1
    symbols = list(symbols)
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merged = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = left + right, ""
        merged += 1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
    return merged


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable ones stand for
    themselves, the others take the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 256
    for b in own:
        out[b] = chr(b)
    for b in range(256):
        if not out[b]:
            out[b], extra = chr(extra), extra + 1
    return out


class Counter:
    """Token counts under one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.ranks = {(a, b): r for r, (a, b) in enumerate(model["merges"])}
        self.suffix = model["end_of_word_suffix"] or ""
        split = next(p for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        special = [t["content"] for t in file["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.bytes = byte_symbols()
        self.library = Tokenizer.from_file(path)
        self.kinds = Recent(self._kind)
        self.pieces = Recent(self._piece)
        self.chunks = Recent(self._chunk)

    def _piece(self, piece: str) -> int:
        symbols = [self.bytes[b] for b in piece.encode()]
        symbols[-1] += self.suffix
        return len(symbols) - merges_of(symbols, self.ranks)

    def _kind(self, c: str) -> str:
        """A Latin stand-in for a character: a letter, a number or neither, as the file's pattern has it."""
        split = self.library.pre_tokenizer.pre_tokenize_str
        return "ǰ" if len(split("a" + c)) == 1 else "¤" if len(split("!" + c)) == 1 else "²"

    def _beyond(self, part: str) -> list[str]:
        """Pieces of a part with characters beyond the Latin blocks."""
        low = self.library.normalizer.normalize_str(part)
        shape = "".join(self.kinds[c] if c >= BEYOND else c for c in low)
        return [low[m.start() : m.end()] for m in self.pattern.finditer(shape)]

    def _chunk(self, chunk: str) -> int:
        """Tokens of a chunk without white space."""
        parts = self.special.split(chunk) if self.special and "<" in chunk else [chunk]
        total = len(parts) - 1
        for part in parts:
            pieces = self._beyond(part) if part and max(part) >= BEYOND else self.pattern.findall(part.lower())
            total += sum(map(self.pieces.__getitem__, pieces))
        return total

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if not text.isascii():
            parts = self.special.split(text) if self.special and "<|" in text else [text]
            if len(parts) > 1:
                return len(parts) - 1 + sum(map(self.count, parts))
            if max(text) < BEYOND:  # else by chunk: white space is no part of any composition
                text = unicodedata.normalize("NFC", text)
        # str.split also parts words at four control characters, which the pattern does not
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        return sum(map(self.chunks.__getitem__, _SPACE.split(text) if odd else text.split()))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The worker's counter for a vocabulary file."""
    return Counter(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """A row per document: ``doc_id, n_bytes, n_tokens, over_limit``.  No shuffle.

    ``vocabulary``: path of a vocabulary file, the same on all executors.
    """
    require(docs, ("doc_id", "text"))

    def run(batches):
        claim("tokens", counter.cache_clear)
        table = counter(vocabulary or vocabulary_path())
        count = table.count
        for batch in batches:
            n = [count(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        table.chunks.forget()
        table.pieces.forget()
        trim()

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
