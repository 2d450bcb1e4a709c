"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only.

Texts are split at ASCII white space if no token, merge, normal form or special string of the vocabulary crosses it, which
is tried out on probes before; the pieces of a batch are encoded once each, in calls of about equal bytes, and their
lengths are added up. So a text of any length costs memory in proportion to its longest run without white space. A
vocabulary whose tokens cross white space gets whole texts, in calls of about equal bytes.

Defined cases: null text counts as empty, with 0 bytes and 0 tokens; rows that repeat an id are counted each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from fieldsense.llm.common import in_slices, releasing

#: Distinct pieces whose counts a worker remembers, and the longest of them in bytes.
REMEMBERED, REMEMBERED_BYTES = 400_000, 48


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: Words and separators that a vocabulary must encode the same together and apart to be split at white space.
PROBES = ("the", "Straße", "don't", "é", "2024", "x1", "漢字", "...", "<b>", "\u0301")
SEPARATORS = (" ", "  ", "\n", "\t", "\r\n", " \x0b\x0c ")


def splits_at_white_space(tokenizer) -> bool:
    """Whether no vocabulary entry and no added string holds white space, and probes are encoded alike together and apart."""
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    own = [*tokenizer.get_vocab(with_added_tokens=True), *(t.content for t in tokenizer.get_added_tokens_decoder().values())]
    if any(set(entry) & set("".join(SEPARATORS)) for entry in own):
        return False
    return all(ids(a + s + b) == ids(a) + ids(b) for a in PROBES for b in PROBES for s in SEPARATORS) and not any(map(ids, SEPARATORS))


def _by_bytes(pieces: Iterable, most: int) -> Iterator[list]:
    part, held = [], 0
    for piece in pieces:
        if part and held + len(piece) > most:
            yield part
            part, held = [], 0
        part.append(piece)
        held += len(piece)
    if part:
        yield part


class Counter:
    def __init__(self, path: str, call_bytes: int):
        self.tokenizer, self.call_bytes, self.known = _tokenizer(path), call_bytes, {}
        self.splits = splits_at_white_space(self.tokenizer)

    def lengths(self, pieces: list[bytes]) -> Iterator[int]:
        for part in _by_bytes(pieces, self.call_bytes):
            yield from (len(x.ids) for x in self.tokenizer.encode_batch([x.decode() for x in part], add_special_tokens=False))

    def counts(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text; texts together hold a bounded number of bytes, but for one long text."""
        if not self.splits:
            return list(self.lengths(texts))
        pieces = [text.split() for text in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set().union(*pieces).difference(self.known)
        lengths = self.known if all(len(x) <= REMEMBERED_BYTES for x in new) else dict(self.known)
        new = sorted(new)
        lengths.update(zip(new, self.lengths(new), strict=True))
        if lengths is not self.known:
            self.known.update((x, lengths[x]) for x in new if len(x) <= REMEMBERED_BYTES)
        return [sum(map(lengths.__getitem__, x)) for x in pieces]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, batch_bytes: int = 4 << 20, call_bytes: int = 256 << 10) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of docs.

    tokenizer_path must be readable on every executor. batch_bytes of text are split and counted at a time,
    call_bytes of new pieces go into one call of the library.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path, call_bytes)
        for batch in batches:
            n_bytes: list[int] = []
            n_tokens: list[int] = []
            for part in _by_bytes(((x or "").encode() for x in in_slices(batch.column(1))), batch_bytes):
                n_bytes += map(len, part)
                n_tokens += counter.counts(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(releasing(run), f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
