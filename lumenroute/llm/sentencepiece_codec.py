"""SentencePiece encoding and decoding with a distinct-chunk table.

No piece of a suitable vocabulary has a whitespace marker after another
character, so no merge crosses the place before a marker: a text can be cut
there into marked words and each be segmented alone. A line feed that no piece
contains together with other characters is such a place too. Every worker
keeps a table of the distinct chunks it has met with their ids; a text's ids
are those of its chunks, joined back by position. The table holds at most
``TABLE_CHUNKS`` chunks and is emptied beyond that, which costs time but
changes no result. For a vocabulary that isn't suitable (checked when it is
loaded), whole texts are segmented instead.

Edge cases: a null text has null ids (and -1 for their number), an empty one no
ids. A text that
contains the marker character itself decodes to a space there, as in the
library, so ``exact`` is false for it. Unknown characters fall back on bytes if
the vocabulary has them; otherwise they decode to the library's unknown sign.
Very long texts are encoded whole. Repeated rows and ties need no rule: rows are
encoded one by one. Other columns pass through ``encode``, ``decode`` and
``with_ids``; one that has the name of a new column is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .cluster import prepare

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TABLE_CHUNKS = 250_000
MARK = "▁"
_CHUNK = re.compile(r"\n+| *[^ \n]+| +")


class Codec(dict):
    """A vocabulary with its table of chunks: maps a chunk to its row of the table."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = [p.piece for p in proto.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)]
        self.suitable = (
            spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
            and not proto.trainer_spec.treat_whitespace_as_suffix
            and not any(MARK in p.lstrip(MARK) or "\n" in p for p in plain)
        )
        pieces = []
        for p in proto.pieces:
            if p.type == kinds.BYTE:
                pieces.append(bytes([int(p.piece[3:-1], 16)]))
            elif p.type == kinds.CONTROL:
                pieces.append(b"")
            elif p.type == kinds.UNKNOWN:
                pieces.append(proto.trainer_spec.unk_surface.encode())
            else:
                pieces.append(p.piece.replace(MARK, " ").encode())
        self.piece_size = np.array([len(p) for p in pieces], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)

    def __missing__(self, chunk: str) -> int:
        row = self[chunk] = len(self)
        self.fresh.append(chunk)
        return row

    def _learn(self) -> None:
        if not self.fresh:
            return
        # the library puts a marker before a text: let it stand for a chunk's own, or fence it off by a line feed
        asked = [c[1:] if c[0] == " " and c[-1] != " " else "\n" + c for c in self.fresh]
        found = self.model.encode(asked, num_threads=1)
        found = [ids[2:] if a[:1] == "\n" else ids for a, ids in zip(asked, found, strict=True)]
        self.size = np.concatenate([self.size, np.fromiter(map(len, found), np.int64, len(found))])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32)])
        self.start = np.cumsum(self.size) - self.size
        self.fresh = []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and their number for each text."""
        if not self.suitable:
            found = self.model.encode([t or "" for t in texts], num_threads=1)
            return np.fromiter(chain.from_iterable(found), np.int32), np.array([len(ids) for ids in found], np.int64)
        if len(self) > TABLE_CHUNKS:
            self.reset()
        parts = [_CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        rows = np.fromiter(map(self.__getitem__, chain.from_iterable(parts)), np.int64, int(count.sum()))
        self._learn()
        size = self.size[rows]
        total = np.r_[0, np.cumsum(size)]
        ids = self.ids[np.repeat(self.start[rows] - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[np.r_[0, np.cumsum(count)]])

    def decode(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of all texts one after another, and the offsets of each; the space put before a text is taken off."""
        size = self.piece_size[ids]
        total = np.r_[0, np.cumsum(size)]
        data = self.piece_bytes[np.repeat(self.piece_start[ids] - total[:-1], size) + np.arange(total[-1])]
        at = total[np.r_[0, np.cumsum(count)]]
        keep = np.ones(len(data), bool)
        heads = at[:-1][at[1:] > at[:-1]]
        keep[heads[data[heads] == 32]] = False
        return data[keep], np.r_[0, np.cumsum(keep)][at]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _replaced(docs: DataFrame, fields: list[T.StructField]) -> tuple[list[str], T.StructType]:
    """The columns that stay beside the new ones, and the schema of all."""
    new = {f.name.lower() for f in fields}
    kept = [f for f in docs.schema.fields if f.name.lower() not in new]
    return [f.name for f in kept], T.StructType([*kept, *fields])


def _found(column: pa.Array, table: Codec) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The ids of all texts, their number for each, and the list column of them."""
    ids, count = table.encode(column.to_pylist())
    out = kernel.lists(ids, count, pa.int32())
    return ids, count, pa.compute.if_else(column.is_valid(), out, pa.scalar(None, out.type)) if column.null_count else out


def encode(docs: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """docs with the ids of ``text`` in a further column."""
    prepare(docs.sparkSession)
    if ids.lower() == "text":
        raise ValueError("the ids can't take the place of the text")
    names, schema = _replaced(docs, [T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec(model)
        for batch in kernel.split_rows(batches, "text", 1 << 20):
            yield pa.record_batch([*(batch.column(c) for c in names), _found(batch.column("text"), table)[2]], [*names, ids])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the text of ``ids`` in a further column."""
    prepare(rows.sparkSession)
    names, schema = _replaced(rows, [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec(model)
        for batch in batches:
            column = batch.column(ids)
            out = []
            step = max(1, int(100_000 * batch.num_rows / max(1, len(column.flatten()))))
            for k in range(0, batch.num_rows, step):
                part = column.slice(k, step)
                count = pa.compute.fill_null(pa.compute.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                data, at = table.decode(part.flatten().to_numpy(zero_copy_only=False), count)
                raw = data.tobytes()
                said = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
                out += [t if ok else None for t, ok in zip(said, part.is_valid().to_pylist(), strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(out, pa.string())], [*names, text])

    return rows.mapInArrow(run, schema)


def with_ids(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs with n_ids, ids and exact: exact says that the ids decode to the text."""
    prepare(docs.sparkSession)
    new = [T.StructField("n_ids", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())]
    names, schema = _replaced(docs, new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec(model)
        for batch in kernel.split_rows(batches, "text", 1 << 20):
            column = batch.column("text")
            ids, count, found = _found(column, table)
            data, at = table.decode(ids, count)
            raw, want = kernel.utf8(column)
            exact = [data[a:b].tobytes() == raw[c:d].tobytes() for a, b, c, d in zip(at, at[1:], want, want[1:], strict=False)]
            n = np.where(column.is_valid().to_numpy(zero_copy_only=False), count, -1)
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(n), found, pa.array(exact, pa.bool_())], schema.names)

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_ids, ids, exact) for every row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_ids(base, model).select("doc_id", "n_ids", "ids", "exact")
