"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression. A batch of texts becomes one array of character classes; each class is a
transition function over the few states of the splitter, composition of such functions is associative, and a blocked
scan over them gives every character its state and so tells where pieces begin. The slices of the UTF-8 buffer between
these places go through pair merging, whose results are remembered; the byte offsets of tokens are kept, so any span
of ids can be mapped back to the text.

Defined cases: null text is encoded as empty (no ids); texts may be of any length; rows that repeat an id are encoded
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldsense.llm.common import in_slices, releasing

#: Character classes. White space inside or at the end of a run, a space before other text, other white space before
#: other text, an apostrophe that begins an ending of one letter ('s 't 'm 'd) or two ('re 've 'll).
LETTER, NUMBER, OTHER, SPACE_RUN, SPACE_LAST, BREAK_LAST, ENDING_1, ENDING_2 = range(8)
#: States after a character.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, AFTER_SPACE, ONE_LEFT, TWO_LEFT = range(8)
#: Code points of white space (fixed values of the Unicode property White_Space).
WHITE_SPACE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
ROW = 64
NO_RANK = 1 << 60


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For class c (+ 8 if the character begins a text) and state s, at 8 * c + s: the next state; 1 if a piece begins."""
    step, begins = np.zeros((16, 8), np.uint8), np.ones((16, 8), np.uint8)
    for c, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER), (SPACE_RUN, IN_SPACE)):
        step[c] = run
        begins[c, run] = 0
    step[SPACE_LAST], step[BREAK_LAST] = AFTER_SPACE, FRESH
    step[ENDING_1], step[ENDING_2] = ONE_LEFT, TWO_LEFT
    for c in (ENDING_1, ENDING_2):
        step[c, [IN_OTHER, AFTER_SPACE]] = IN_OTHER
        begins[c, [IN_OTHER, AFTER_SPACE]] = 0
    begins[[LETTER, NUMBER, OTHER], AFTER_SPACE] = 0
    step[LETTER, ONE_LEFT], step[LETTER, TWO_LEFT] = FRESH, ONE_LEFT
    begins[LETTER, [ONE_LEFT, TWO_LEFT]] = 0
    step[8:] = step[:8, [FRESH]]
    return step.ravel(), begins.ravel()


STEP, BEGINS = _tables()


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each code point: LETTER, NUMBER, OTHER or SPACE_RUN."""
    import regex

    kinds = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            kinds[m.start() : m.end()] = kind
    kinds[WHITE_SPACE] = SPACE_RUN
    return kinds


def classes(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Classes of the code points of texts laid end to end; firsts: where texts begin."""
    out = _kinds()[points]
    n = len(points)
    begins = np.zeros(n + 3, bool)
    begins[firsts] = True
    begins[n:] = True
    space = out == SPACE_RUN
    last = space.copy()
    last[:-1] &= ~space[1:]
    last &= ~begins[1 : n + 1]
    out[last] = np.where(points[last] == 32, SPACE_LAST, BREAK_LAST)
    quotes = np.flatnonzero(points == 39)
    quotes = quotes[~begins[quotes + 1]]
    if len(quotes):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[quotes + 1], np.where(begins[quotes + 2], 0, padded[quotes + 2])
        out[quotes[np.isin(one, [115, 116, 109, 100])]] = ENDING_1
        pair = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        out[quotes[pair]] = ENDING_2
    out[firsts] += 8
    return out


def piece_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Positions at which pieces begin, by a scan over transition functions in rows of ROW characters."""
    n = len(points)
    rows = -(-n // ROW)
    by_step = np.zeros((rows, ROW), np.uint8)
    by_step.ravel()[:n] = classes(points, firsts)
    by_step = np.ascontiguousarray(by_step.T) << 3
    # Each row's function, as its result for each state at its beginning.
    func = np.repeat(np.arange(8, dtype=np.uint8)[:, None], rows, axis=1)
    for at in by_step:
        func = STEP[at + func]
    # Prefix composition over rows, doubling the distance.
    apart = 1
    while apart < rows:
        func[:, apart:] = np.take_along_axis(func[:, apart:], func[:, :-apart], axis=0)
        apart *= 2
    state = np.concatenate([np.zeros(1, np.uint8), func[FRESH, :-1]])
    found = np.empty((ROW, rows), np.uint8)
    for k, at in enumerate(by_step):
        at = at + state
        found[k] = BEGINS[at]
        state = STEP[at]
    return np.flatnonzero(found.T.ravel()[:n])


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Join the pair of lowest rank, leftmost first, until no pair has a rank."""
    if piece in ranks:
        return (ranks[piece],)
    if len(piece) > 40:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    rank = [ranks.get(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
    while rank and (best := min(rank)) != NO_RANK:
        i = rank.index(best)
        parts[i] += parts.pop(i + 1)
        del rank[i]
        if i < len(rank):
            rank[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
        if i:
            rank[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
    return tuple(map(ranks.__getitem__, parts))


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same with a heap of pairs over a linked list, for pieces of any length."""
    n = len(piece)
    ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n and (r := ranks.get(piece[i : ends[after[i]]])) is not None:
            heapq.heappush(heap, (r, i, ends[after[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if ends[i] else n
        if j >= n or ends[j] != end:
            continue
        ends[i], after[i] = end, after[j]
        if after[j] < n:
            before[after[j]] = i
        ends[j] = 0
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = after[i]
    return tuple(out)


class _Merged(dict):
    """Ids by piece. When it holds `most` pieces they become the older ones, which are forgotten at the next time."""

    def __init__(self, ranks: dict[bytes, int], most: int = 100_000):
        self.ranks, self.most, self.older = ranks, most, {}

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        ids = self.older.get(piece) or merge(piece, self.ranks)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=1)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Codec:
    def __init__(self, path: str):
        self.ranks = _ranks(path)
        self.merged = _Merged(self.ranks)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        self.decimal = [str(i) for i in range(len(self.bytes_of))]

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text."""
        firsts = np.cumsum([0, *map(len, texts)])
        joined = "".join(texts)
        if not joined:
            yield from ([] for _ in texts)
            return
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = piece_starts(points, np.unique(firsts[:-1][np.diff(firsts) > 0]))
        offsets = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int8), out=offsets[1:])
        cuts = offsets[np.append(starts, len(points))].tolist()
        per_text = np.searchsorted(starts, firsts).tolist()
        buffer, get = joined.encode(), self.merged.__getitem__
        for a, b in zip(per_text, per_text[1:], strict=False):
            yield list(chain.from_iterable(get(buffer[s:e]) for s, e in zip(cuts[a:b], cuts[a + 1 : b + 1], strict=True)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, ids: list[int]) -> list[int]:
        """The byte at which each token begins, and the length of all."""
        return np.cumsum([0, *(len(self.bytes_of[i]) for i in ids)]).tolist()


def _parts(texts: Iterable[str], most: int) -> Iterator[list[str]]:
    part, held = [], 0
    for text in texts:
        if part and held + len(text) > most:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


#: What encode() can return for a row.
OUTPUTS = {
    "n_tokens": ("long", pa.int64(), lambda codec, ids: len(ids)),
    "ids": ("array<int>", pa.list_(pa.int32()), lambda codec, ids: ids),
    "offsets": ("array<long>", pa.list_(pa.int64()), lambda codec, ids: codec.offsets(ids)),
    "decoded": ("binary", pa.binary(), lambda codec, ids: codec.decode(ids)),
    "ids_sha256": ("string", pa.string(), lambda codec, ids: hashlib.sha256(",".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest()),
    "decoded_sha256": ("string", pa.string(), lambda codec, ids: hashlib.sha256(codec.decode(ids)).hexdigest()),
}


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "offsets"), batch_chars: int = 1 << 19) -> DataFrame:
    """(id, *outputs) for each row of docs, outputs from OUTPUTS. ranks_path must be readable on every executor.

    batch_chars are classified and scanned at a time; a longer text makes a batch of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks_path)
        for batch in batches:
            texts = ("" if x is None else x for x in in_slices(batch.column(1)))
            values: list[list] = [[] for _ in outputs]
            for part in _parts(texts, batch_chars):
                for ids in codec.encode(part):
                    for name, column in zip(outputs, values, strict=True):
                        column.append(OUTPUTS[name][2](codec, ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, OUTPUTS[k][1]) for k, v in zip(outputs, values, strict=True))], names=[id_col, *outputs])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(releasing(run), ", ".join([f"`{id_col}` {kind}", *(f"{k} {OUTPUTS[k][0]}" for k in outputs)]))


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), outputs=DIGESTS)
