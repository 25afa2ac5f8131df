"""Token counts of whole texts; huge ones by overlap resynchronisation.

A huge text is cut into overlapping chunks that are encoded with offsets. Two
neighbours are spliced at a position that is a token boundary in both and is
provably one in the whole text: a white-space character after a non-space one
always begins a pre-token, whatever stands to its left, because no alternative
of the byte-level pattern (nor a special string) crosses from non-space into
space. Where an overlap holds no such position, it is widened; in the end the
two chunks become one.

Null text counts as empty (0 tokens); special strings inside texts are tokens of
their own, as is the library's default. Repeated rows are counted each; no rows give
none; columns of other names are ignored.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, holds, slices

#: Characters: texts up to HUGE are encoded at once; longer ones in chunks that overlap.
HUGE, CHUNK, OVERLAP = 32_768, 16_384, 512


@lru_cache(maxsize=2)
def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


holds("tokencount", library.cache_clear)


def stable(text: str, lo: int, hi: int) -> Iterator[int]:
    """Positions in (lo, hi) from the middle outwards where white space follows a non-space."""
    mid = (lo + hi) // 2
    for d in range((hi - lo) // 2):
        for p in (mid + d, mid - d):
            if lo < p < hi - 1 and text[p] in " \n\t\r" and not text[p - 1].isspace():
                yield p


def count_huge(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text`` by splicing overlapping chunks."""
    total, start, left = 0, 0, 0  # tokens from `left` on aren't counted yet; the chunk starts at `start` <= left
    end = min(len(text), chunk)
    while True:
        here = [a for a, _ in tok.encode(text[start:end], add_special_tokens=False).offsets]
        if end == len(text):
            return total + len(here) - bisect_left(here, left - start)
        width, splice = overlap, None
        while splice is None and end - width > left:
            b0 = end - width
            there = {a + b0 for a, _ in tok.encode(text[b0:end], add_special_tokens=False).offsets}
            mine = {a + start for a in here}
            splice = next((p for p in stable(text, b0, end) if p in there and p in mine), None)
            if splice is None:
                width *= 2
        if splice is None:  # no safe boundary: the chunk itself is widened
            end = min(len(text), end + (end - start))
            continue
        total += bisect_left(here, splice - start) - bisect_left(here, left - start)
        start, left = end - width, splice
        end = min(len(text), splice + chunk)


def counts(tok, texts: list[str]) -> list[int]:
    if not hasattr(tok, "encode_batch_fast"):
        return [len(x) for x in tok.encode(texts, num_threads=1)]
    short = [i for i, t in enumerate(texts) if len(t) <= HUGE]
    out = [0] * len(texts)
    for i, e in zip(short, tok.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True):
        out[i] = len(e)
    for i, t in enumerate(texts):
        if len(t) > HUGE:
            out[i] = count_huge(tok, t)
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("tokencount")
        tok = library(path)
        for whole in batches:
            for b in slices(whole, text, 1 << 20):
                n = counts(tok, [t or "" for t in b.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    plain = docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias(text))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
