"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

A segmentation is a path through the lattice of pieces, the state at a cut being the piece that covers the character
before it.  A chunk of a giant document yields the matrix of best path scores from each state at its left cut to each
state at its right cut; matrices combine associatively by the max-plus product, a scan gives the best state at every
cut, and each chunk is then backtraced by itself between its two states.

Edge scores: for a unigram model the score of the piece.  A byte-pair model has no additive scores; there an edge scores
0 if the two pieces, merged from their joint characters by the model's own rule, come out as the same two pieces, and
minus infinity otherwise.  The merged segmentation is the one path without a forbidden edge, so the scan finds just what
the library gives for the whole text; scores being 0 or minus infinity, a set of entries is a bit mask.

Documents below ``giant`` characters go to the library as they are.

Defined cases: null and empty texts have no pieces and decode to an empty text; rows that repeat an id are encoded each by
itself; characters without a piece become bytes; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.shared import give_back, materialize
from trellis.llm.words import flatten, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT = 1 << 16
CHUNK = 1 << 14
_BATCH = 1 << 20
_NO = float("-inf")
_SPACE = "\u2581"
#: Pairs of pieces that a worker keeps at most.
_KEPT = 1 << 16
State = tuple[int, int]  # where the covering piece begins and ends, from the cut


class Codec:
    """A model with its pieces, and the edges of its lattice."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model, n = self.library, self.library.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.ids = {model.id_to_piece(i): i for i in range(n) if not special[i]}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(model.is_byte(i) for i in range(n)) else None
        self.longest = max(map(len, self.ids))
        self.begun = {p[:n] for p in self.ids for n in range(2, len(p) + 1)}
        self.unknown = min(self.scores.values()) - 10
        # log-probabilities of a unigram model are fractions; a byte-pair model counts its merges
        self.is_unigram = any(s != int(s) for s in self.scores.values())
        self.pairs: dict[tuple[str, str], bool] = {}
        self.by_word = _SPACE in self.ids and not any(_SPACE in p.lstrip(_SPACE) for p in self.ids) and library_marks_spaces(model)
        self.table = [b"" if model.is_control(i) else model.id_to_piece(i).replace(_SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.bytes or ()):
            self.table[i] = bytes([b])

    def merged(self, text: str) -> list[str]:
        """The byte-pair segmentation of a short text: best-scored adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            found = [(self.scores.get(a + b, _NO), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            score, at = max(found)
            if score == _NO:
                break
            parts[-at : -at + 2] = [parts[-at] + parts[-at + 1]]
        return parts

    def follows(self, before: str, piece: str) -> bool:
        """Whether a byte-pair model keeps two neighbouring pieces apart."""
        key = (before, piece)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= _KEPT:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return found

    def encode(self, texts: list[str]) -> list[array]:
        """The library's ids of each text."""
        return [array("i", ids) for ids in self.library.encode(texts, num_threads=1)]

    def decode(self, ids: list[int]) -> str:
        """The library's text of ids."""
        table = self.table
        try:
            text = b"".join([table[i] for i in ids]).decode()
        except (UnicodeDecodeError, IndexError):
            return self.library.decode(ids)
        return text.removeprefix(" ") if self.by_word and self.library.unk_id() not in ids else self.library.decode(ids)

    def starting(self, text: str, at: int, end: int) -> list[int]:
        """Ends of the pieces that begin at ``at``; a single character always is one."""
        found = [at + 1]
        for stop in range(at + 2, min(at + self.longest, end) + 1):
            piece = text[at:stop]
            if piece not in self.begun:
                break
            if piece in self.ids:
                found.append(stop)
        return found

    def id_list(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.library.unk_id()]


def library_marks_spaces(model) -> bool:
    """Whether the model only puts a mark before the text and in the place of each space."""
    odd = " a  b\u00a0\ufb01 \u00c5\u2460\n\t c "
    return model.normalize(odd) == _SPACE + odd.replace(" ", _SPACE)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def entry_states(model: Codec, text: str, cut: int) -> list[State]:
    """Pieces that cover the character before the cut."""
    if cut == 0:
        return [(0, 0)]
    begin = max(0, cut - model.longest)
    return [(a - cut, b - cut) for a in range(begin, cut) for b in model.starting(text, a, len(text)) if a < cut <= b]


def transfer(model: Codec, text: str, left: int, right: int) -> tuple[list[State], list[State], np.ndarray]:
    """Entry states, exit states and best scores between them of the chunk text[left:right] in its surroundings."""
    entries = entry_states(model, text, left)
    reach = _best_scores if model.is_unigram else _allowed
    exits = reach(model, text, right, {(left + a, left + b): k for k, (a, b) in enumerate(entries)})
    states = sorted(exits)
    return entries, [(a - right, b - right) for a, b in states], np.stack([exits[s] for s in states], axis=1) if states else np.zeros((len(entries), 0))


def _allowed(model: Codec, text: str, right: int, entries: dict[State, int]) -> dict[State, np.ndarray]:
    """Scores of exits under 0 and minus infinity: which entries reach each piece, as bits."""
    at: dict[int, dict[int, int]] = {}
    for (a, b), k in entries.items():
        at.setdefault(b, {})[a] = at.get(b, {}).get(a, 0) | 1 << k
    exits: dict[State, int] = {}
    follows, last = model.follows, len(text)
    for p in range(min(at), last + 1):
        here = at.pop(p, None)
        if not here:
            continue
        if p >= right:
            exits.update({(a, p): mask for a, mask in here.items()})
            continue
        before = [(text[a:p], mask) for a, mask in here.items()]
        for end in model.starting(text, p, last):
            piece, found = text[p:end], 0
            for b, mask in before:
                if mask & ~found and follows(b, piece):
                    found |= mask
            if found:
                at.setdefault(end, {})[p] = found
    n = len(entries)
    return {s: np.where([mask >> k & 1 for k in range(n)], 0.0, _NO) for s, mask in exits.items()}


def _best_scores(model: Codec, text: str, right: int, entries: dict[State, int]) -> dict[State, np.ndarray]:
    """Scores of exits under sums of piece scores."""
    at: dict[int, dict[int, np.ndarray]] = {}
    for (a, b), k in entries.items():
        at.setdefault(b, {}).setdefault(a, np.full(len(entries), _NO))[k] = 0.0
    exits: dict[State, np.ndarray] = {}
    for p in range(min(at), len(text) + 1):
        here = at.pop(p, None)
        if not here:
            continue
        if p >= right:
            exits.update({(a, p): v for a, v in here.items()})
            continue
        best = functools.reduce(np.maximum, here.values())
        for end in model.starting(text, p, len(text)):
            at.setdefault(end, {})[p] = best + model.scores.get(text[p:end], model.unknown)
    return exits


Matrix = tuple[list[State], list[State], np.ndarray]


def combine(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product; states that only one side knows lead nowhere."""
    shared = [(i, b[0].index(s)) for i, s in enumerate(a[1]) if s in set(b[0])]
    if not shared:
        return a[0], b[1], np.full((len(a[0]), len(b[1])), _NO)
    i, j = (list(x) for x in zip(*shared, strict=True))
    return a[0], b[1], (a[2][:, i][:, :, None] + b[2][j][None, :, :]).max(axis=1)


def prefixes(matrices: list[Matrix]) -> list[Matrix]:
    """All products of leading matrices, by pairs (a scan of logarithmic depth)."""
    if len(matrices) == 1:
        return matrices
    half = prefixes([combine(matrices[i], matrices[i + 1]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)])
    return [half[k // 2] if k % 2 or k == len(matrices) - 1 else (matrices[0] if k == 0 else combine(half[k // 2 - 1], matrices[k])) for k in range(len(matrices))]


def best_states(matrices: list[Matrix]) -> list[tuple[State, State]]:
    """Entry and exit state of each chunk on the best path through all of them."""
    leading = prefixes(matrices)
    ends = leading[-1]
    whole = [k for k, s in enumerate(ends[1]) if s[1] == 0]
    state = ends[1][max(whole, key=lambda k: ends[2][0, k])]
    out = []
    for k in range(len(matrices) - 1, -1, -1):
        entries, exits, scores = matrices[k]
        column = scores[:, exits.index(state)]
        if k == 0:
            before = entries[0]
        else:
            known = dict(zip(leading[k - 1][1], leading[k - 1][2][0], strict=True))
            before = max(entries, key=lambda s: known.get(s, _NO) + column[entries.index(s)])
        out.append((before, state))
        state = before
    return out[::-1]


def backtrace(model: Codec, text: str, left: int, right: int, entry: State, leave: State) -> list[int]:
    """Ids of the pieces after the entry state up to the exit state."""
    at: dict[int, dict[int, tuple[float, int]]] = {left + entry[1]: {left + entry[0]: (0.0, -1)}}
    for p in range(left + entry[1], right):
        here = at.get(p)
        if not here:
            continue
        for end in model.starting(text, p, len(text)):
            piece, best = text[p:end], (_NO, 0)
            for a, (score, _) in here.items():
                if score > best[0] and (model.is_unigram or model.follows(text[a:p], piece)):
                    best = (score, a)
            if best[0] > _NO:
                at.setdefault(end, {})[p] = (best[0] + (model.scores.get(piece, model.unknown) if model.is_unigram else 0.0), best[1])
    begin, end, pieces = right + leave[0], right + leave[1], []
    while (begin, end) != (left + entry[0], left + entry[1]):
        pieces.append(text[begin:end])
        begin, end = at[end][begin][1], begin
    return [i for piece in reversed(pieces) for i in model.id_list(piece)]


def encode_giant(model: Codec, text: str, chunk: int = CHUNK) -> list[int]:
    """One text through the whole scan in one process."""
    normal = model.library.normalize(text)
    cuts = [*range(0, len(normal), chunk), len(normal)]
    if len(cuts) < 2:
        return []
    around = [_surrounded(model, normal, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    states = best_states([transfer(model, *x) for x in around])
    return [i for x, s in zip(around, states, strict=True) for i in backtrace(model, *x, *s)]


def _surrounded(model: Codec, text: str, a: int, b: int) -> tuple[str, int, int]:
    low = max(0, a - model.longest)
    return text[low : b + model.longest], a - low, b - low


def _lists(ids: list[array]) -> pa.ListArray:
    flat = np.frombuffer(b"".join(ids), np.int32)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in ids])], pa.int32()), pa.array(flat))


_CHUNKS_A_TASK = 4
_CHUNKS = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("part", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())])
_MATRICES = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("m", pa.binary())])


def _giant_ids(giants: DataFrame, path: str, chunk: int) -> DataFrame:
    """(row, ids) of giant texts (row, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                normal = model.library.normalize(text)
                for k, a in enumerate(range(0, len(normal), chunk)):
                    part, left, right = _surrounded(model, normal, a, min(a + chunk, len(normal)))
                    yield pa.RecordBatch.from_pylist([{"row": row, "k": k, "part": part, "lo": left, "hi": right}], _CHUNKS)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{"row": r["row"], "k": r["k"], "m": pickle.dumps(transfer(model, r["part"], r["lo"], r["hi"]))}], _MATRICES)

    def scan(chunks: pa.Table) -> pa.Table:
        chunks = chunks.sort_by("k")
        states = best_states([pickle.loads(m) for m in chunks["m"].to_pylist()])
        return pa.table({"row": chunks["row"], "k": chunks["k"], "states": pa.array([[*a, *b] for a, b in states], pa.list_(pa.int32()))})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            for r in batch.to_pylist():
                s = r["states"]
                ids = backtrace(model, r["part"], r["lo"], r["hi"], (s[0], s[1]), (s[2], s[3]))
                yield pa.RecordBatch.from_arrays([pa.array([r["row"]]), pa.array([r["k"]], pa.int32()), pa.array([ids], pa.list_(pa.int32()))], names=["row", "k", "ids"])

    chunks = materialize(giants.mapInArrow(cut, "row long, k int, part string, lo int, hi int"), "chunks")
    # a stated number, which adaptive execution leaves alone: chunks are few bytes and much work
    spread = chunks.repartition(max(1, -(-chunks.count() // _CHUNKS_A_TASK)), F.col("row"), F.col("k"))
    states = spread.mapInArrow(matrices, "row long, k int, m binary").groupBy("row").applyInArrow(scan, "row long, k int, states array<int>")
    traced = spread.join(states, ["row", "k"]).mapInArrow(trace, "row long, k int, ids array<int>")
    return traced.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode(df: DataFrame, text_col: str = "text", out_col: str = "ids", path: str = MODEL, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """``df`` with the piece ids of each text in ``out_col`` (array<int>); a column of that name is replaced."""
    df = df.drop(out_col)
    key = _unused("__row", df)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            where = batch.schema.names.index(text_col)
            _, offsets = flatten(batch.column(where))
            for i, j in slices(offsets, _BATCH):
                part = batch.slice(i, j - i)
                ids = model.encode([t or "" for t in part.column(where).cast(pa.string()).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids)], names=[*part.schema.names, out_col])
        give_back()

    plain = df.filter(F.length(text) < giant)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out_col}` array<int>"
    done = plain.mapInArrow(run, schema)
    giants = materialize(df.filter(F.length(text) >= giant).withColumn(key, F.monotonically_increasing_id()), "giants")
    if giants.isEmpty():
        return done
    ids = _giant_ids(giants.select(F.col(key).alias("row"), F.col(text_col).cast("string").alias("text")), path, chunk)
    large = giants.join(ids, giants[key] == ids["row"], "left").select(*(giants[c] for c in df.columns), F.coalesce(ids["ids"], F.array().cast("array<int>")).alias(out_col))
    return done.unionByName(large)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str = MODEL, digest_col: str | None = None) -> DataFrame:
    """``df`` with the text of the piece ids in ``out_col``; ``digest_col``: their SHA-256, as little-endian 32-bit numbers.

    Columns of these names are replaced.
    """
    df = df.drop(out_col, *([digest_col] if digest_col else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            where = batch.schema.names.index(ids_col)
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                column = part.column(where).fill_null([]) if part.column(where).null_count else part.column(where)
                flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype("<i4"), column.value_lengths().to_numpy(zero_copy_only=False)
                bounds = np.r_[0, np.cumsum(sizes)].tolist()
                each = [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
                more = [pa.array([model.decode(ids.tolist()) for ids in each], pa.string())]
                if digest_col:
                    more.append(pa.array([sha_of(ids) for ids in each]))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, out_col, *([digest_col] if digest_col else [])])
        give_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out_col}` string" + (f", `{digest_col}` string" if digest_col else "")
    return df.mapInArrow(run, schema)


def _unused(name: str, df: DataFrame) -> str:
    """A column name that ``df`` doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def sha_of(ids) -> str:
    return hashlib.sha256(np.asarray(ids, "<i4").tobytes()).hexdigest()
