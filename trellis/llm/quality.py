"""Quality rules: repetition coverage.

Rolling hashes of several n-gram lengths find the word n-grams and lines of a text that occur before in the same text;
the characters inside them, as a share of the text's word characters, decide.  Everything is numpy over whole Arrow
batches; no row depends on another, so nothing is shuffled.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows are judged each by itself; an
empty table gives an empty result; columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trellis.llm.shared import give_back
from trellis.llm.words import U64, Words, flatten, mix, repeated, slices

_SLICE = 1 << 20
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1

#: Percent of word characters that may lie in n-grams seen before in the text, by n.
NGRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Percent of line characters that may lie in lines seen before in the text.
LINE_LIMIT = 30


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    window: int = 5
    window_percent: int = 20
    ngram_limits: dict[int, int] = field(default_factory=lambda: dict(NGRAM_LIMITS))
    line_limit: int = LINE_LIMIT

    def names(self) -> list[str]:
        return [f"dup_chars_{n}" for n in sorted(self.ngram_limits)]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _spread(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    edge = np.zeros(n + size + 1, np.int64)
    edge[:n] = np.bincount(starts, minlength=n)[:n] if n else 0
    edge[size : n + size] -= edge[:n].copy()
    return np.cumsum(edge)[:n] > 0


def _later(keys: np.ndarray) -> np.ndarray:
    """Which keys occur earlier in the array too."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    seen = np.zeros(len(keys), bool)
    seen[order[1:]] = ranked[1:] == ranked[:-1]
    return seen


def measure(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """The measures of each document of a run."""
    n_docs = len(offsets) - 1
    words = Words(data, offsets)
    hashes = words.hashes()
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    lengths = points[words.ends] - points[words.starts]
    salt = mix(np.arange(1, n_docs + 1, dtype=U64))
    out = {"n_words": words.count, "word_chars": _sums(lengths, words.at), "n_symbols": _sums(_SYMBOL[data], offsets)}

    # lines: cut at \n and at the ends of documents
    cut = np.flatnonzero(data == 10)
    line_start = np.unique(np.r_[offsets[:-1][np.diff(offsets) > 0], cut + 1])
    line_start = line_start[line_start < len(data)]
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    line_end = np.minimum(np.r_[line_start[1:], len(data)], offsets[line_doc + 1])
    line_end = np.where((line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10), line_end - 1, line_end) if len(line_start) else line_end
    n_words_in = np.searchsorted(words.starts, line_end) - np.searchsorted(words.starts, line_start)
    full = n_words_in > 0
    line_start, line_end, line_doc = line_start[full], line_end[full], line_doc[full]
    whole = Words.__new__(Words)
    whole.data, whole.starts, whole.ends = data, line_start, line_end
    seen = _later(whole.hashes() ^ salt[line_doc]) if len(line_start) else np.zeros(0, bool)
    chars = points[line_end] - points[line_start]
    out["n_dup_lines"] = np.bincount(line_doc[seen], minlength=n_docs)
    out["line_chars"] = np.bincount(line_doc, weights=chars, minlength=n_docs).astype(np.int64)
    out["dup_line_chars"] = np.bincount(line_doc[seen], weights=chars[seen], minlength=n_docs).astype(np.int64)

    def starts_of(size: int) -> tuple[np.ndarray, np.ndarray]:
        at, keys = words.grams(hashes, size)
        return at, keys ^ salt[words.doc[at]]

    at, keys = starts_of(rules.window)
    twice = repeated(keys)
    out["n_repeat_words"] = _sums(_spread(len(words), at[twice], rules.window), words.at)
    for size in sorted(rules.ngram_limits):
        at, keys = starts_of(size)
        hit = at[_later(keys)]
        out[f"dup_chars_{size}"] = _sums(np.where(_spread(len(words), hit, size), lengths, 0), words.at)
    return out


def verdict(m: dict[str, np.ndarray], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) of each document, in integers only."""
    base = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.window_percent * m["n_words"])
    bad = 100 * m["dup_line_chars"] > rules.line_limit * m["line_chars"]
    for size, limit in rules.ngram_limits.items():
        bad = bad | (100 * m[f"dup_chars_{size}"] > limit * m["word_chars"])
    return base, ~(base | bad)


def _judged(column, rules: Rules) -> dict[str, np.ndarray]:
    data, offsets = flatten(column)
    parts = []
    for i, j in slices(offsets, _SLICE):
        m = measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], rules)
        m["base_failed"], m["kept"] = verdict(m, rules)
        parts.append(m)
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def repetition_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per input row: the id, the measures, base_failed and kept."""
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["line_chars", "dup_line_chars", *rules.names()]
    fields = [T.StructField(c, T.LongType()) for c in longs] + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")] + [T.StructField(c, T.LongType()) for c in more]
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _judged(batch.column("text"), rules)
                arrays = [batch.column("id"), *(pa.array(m[f.name], pa.bool_() if f.name in ("base_failed", "kept") else pa.int64()) for f in fields)]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *(f.name for f in fields)])
        give_back()

    return source.mapInArrow(run, schema)


def keep_good(df: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``df`` whose text the rules keep, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_judged(batch.column(text_col), rules)["kept"]))
        give_back()

    return df.mapInArrow(run, df.schema)
