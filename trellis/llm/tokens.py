"""Token counts: offset-mapped attribution.

A document is encoded once, as a whole.  Byte-level tokens say by their lengths where each begins and ends, so their
spans follow from a running sum; the spans are interval-joined to sections (by default the lines of the text, each with
its line end) by binary search, and a token that crosses a boundary goes by an explicit rule:

* ``first``: to the section of its first byte,
* ``most`` (default): to the section that holds most of its bytes, the earliest of several,
* ``last``: to the section of its last byte.

Counts per section therefore always add up to the count of the document.

Defined cases: null and empty texts have no tokens and one empty section; rows that repeat an id are counted each by
itself; runs of white space of any length are encoded; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from trellis.llm.words import flatten

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are cut before merging: a fixed value that belongs to the file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space runs from here on are cut outside the library, whose matcher overflows on very long ones.
_LONG_RUN = regex.compile(r"\s{5000}")
RULES = ("first", "most", "last")


class Encoder:
    """A byte-level tokenizer and the byte length of each token."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        self.library = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(token) for token in ranks]

    def encode(self, text: str) -> list[int]:
        if len(text) < 5000 or not _LONG_RUN.search(text):
            return self.library.encode_ordinary(text)
        return [t for m in self.pattern.finditer(text) for t in self.library._encode_single_piece(m.group())]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def lines(data: np.ndarray) -> np.ndarray:
    """First bytes of the lines of a text, and its end."""
    cuts = np.flatnonzero(data == 10) + 1
    return np.unique(np.r_[0, cuts[cuts < len(data)], len(data)])


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section [bounds[i], bounds[i+1]), and how many tokens cross a boundary."""
    starts = np.r_[0, ends][:-1]
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    crossing = np.flatnonzero(first != last)
    to = last if rule == "last" else first
    if rule == "most":
        to = first.copy()
        for i in crossing.tolist():
            cuts = np.r_[starts[i], bounds[first[i] + 1 : last[i] + 1], ends[i]]
            to[i] = first[i] + int(np.argmax(np.diff(cuts)))
    return np.bincount(to, minlength=max(1, len(bounds) - 1)), len(crossing)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, rule: str = "most", sections: Callable[[np.ndarray], np.ndarray] = lines) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, n_sections, n_crossing, section_ends (bytes), section_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    source = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    schema = f"`{id_col}` long, n_bytes long, n_tokens long, n_sections long, n_crossing long, section_ends array<long>, section_tokens array<long>"
    names = [id_col, "n_bytes", "n_tokens", "n_sections", "n_crossing", "section_ends", "section_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                data, offsets = flatten(part.column("text"))
                out: list[list] = [[] for _ in range(6)]
                for i in range(part.num_rows):
                    own = data[offsets[i] : offsets[i + 1]]
                    ids = tokenizer.encode(own.tobytes().decode("utf-8", "replace")) if len(own) else []
                    ends, bounds = np.cumsum(tokenizer.sizes[ids]) if ids else np.zeros(0, np.int64), sections(own)
                    if len(bounds) < 2:
                        bounds = np.zeros(2, np.int64)
                    tokens, crossing = attribute(ends, bounds, rule)
                    for column, value in zip(out, (len(own), len(ids), len(bounds) - 1, crossing, bounds[1:], tokens), strict=True):
                        column.append(value)
                longs = [pa.array(c, pa.int64()) for c in out[:4]]
                lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in c])], pa.int32()), pa.array(np.concatenate(c), pa.int64())) for c in out[4:]]
                yield pa.RecordBatch.from_arrays([part.column("id"), *longs, *lists], names=names)

    return source.mapInArrow(run, schema)
