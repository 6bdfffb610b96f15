"""Token counts by section: a document is encoded once, and its tokens are joined to sections by character spans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from starfold.llm.common import lean, others

#: How a token that crosses a boundary counts: for the section of its first or last
#: character, for the one with most of its characters (the earlier of equals), or for each by its share.
RULES = ("start", "end", "most", "share")

Spans = list[tuple[int, int]]


def lines(text: str) -> Spans:
    """Character spans of a text's lines, each with its line break."""
    ends = [m.end() for m in re.finditer("\n", text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return list(zip([0, *ends[:-1]], ends, strict=True))


def character_spans(data: bytes, token_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one character places of tokens that cover ``data``; a token with part of a character has it whole."""
    begins = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    place = np.cumsum(begins) - 1
    stop = np.cumsum(token_bytes)
    return place[stop - token_bytes], place[stop - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, sections: Spans, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of the tokens that touch it cross one of its boundaries.

    Sections are in order and disjoint; tokens are in order. What lies in no section counts nowhere.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    low = np.array([s for s, _ in sections], np.int64)
    high = np.array([e for _, e in sections], np.int64)
    counts, crossing = np.zeros(len(sections)), np.zeros(len(sections), np.int64)
    if not len(sections) or not len(starts):
        return counts, crossing
    first = np.searchsorted(high, starts, "right")  # the first section that ends behind the token's start
    last = np.searchsorted(low, ends, "left") - 1
    inside = (first == last) & (first < len(sections))
    inside[inside] = (low[first[inside]] <= starts[inside]) & (ends[inside] <= high[first[inside]])
    np.add.at(counts, first[inside], 1)
    for t in np.flatnonzero(~inside & (first <= last)):
        touched = np.arange(first[t], last[t] + 1)
        overlap = np.minimum(high[touched], ends[t]) - np.maximum(low[touched], starts[t])
        touched, overlap = touched[overlap > 0], overlap[overlap > 0]
        crossing[touched] += 1
        if rule == "share":
            counts[touched] += overlap / (ends[t] - starts[t])
        elif rule == "most":
            if len(touched):
                counts[touched[np.argmax(overlap)]] += 1
        else:
            at = starts[t] if rule == "start" else ends[t] - 1
            counts[touched[(low[touched] <= at) & (at < high[touched])]] += 1
    return counts, crossing


def count_tokens(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", sections: Callable[[str], Spans] = lines, rule: str = "most") -> DataFrame:
    """One row a section: the row's other columns, ``section`` (from 0), ``start``, ``stop``, ``n_tokens``, ``n_crossing``.

    Every whole text is encoded once, without special tokens; ``sections`` names ordered
    disjoint character spans. A null or empty text has one empty section without tokens.
    With spans that cover the text and any rule, a document's ``n_tokens`` add up to its
    tokens. Columns of the added names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    made = {"section": T.IntegerType(), "start": T.LongType(), "stop": T.LongType(), "n_tokens": T.DoubleType(), "n_crossing": T.LongType()}
    keep = others(docs, text, *made)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, t) for n, t in made.items()])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks, pattern = shared.value
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        size = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        for whole in stream:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows, parts = [], []
                for i, value in enumerate(batch.column(batch.schema.get_field_index(text))):
                    t = value.as_py() or ""
                    spans = sections(t)
                    starts, ends = character_spans(t.encode(), size[np.array(encode(t), np.int64)]) if t else (np.empty(0), np.empty(0))
                    counts, crossing = attribute(starts, ends, spans, rule)
                    rows.append(np.full(len(spans), i))
                    parts.append((np.arange(len(spans)), [s for s, _ in spans], [e for _, e in spans], counts, crossing))
                kept = batch.select(keep).take(pa.array(np.concatenate(rows))) if keep else None
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
                columns = [pa.array(np.concatenate([p[k] for p in parts]), kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(kept.columns if kept else []), *columns], names=[*keep, *made])

    return docs.mapInArrow(lean(run), schema)
