"""SentencePiece encoding and decoding by a table of distinct chunks (operator 1).

The model marks white space (U+2581) and none of its pieces has a mark after another character,
so no piece crosses from one marked word into the next. A slice of texts is cut into marked words; a
table of the distinct ones is made, the library segments each of them once, in one call, and
their ids are joined back by the words' positions. Decoding gathers the pieces' bytes by the ids likewise. A slice
holds at most SLICE characters (or one longer text), so the table is bounded. A shuffle of every word
occurrence to a single global table would move far more bytes than the texts themselves.

Null text counts as empty: no ids, empty decoded text. Very long texts are encoded whole. Repeated rows give repeated results. An
empty table gives no rows. A column of the input that is named like an output column is replaced, others pass through.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.shared import documents, portions, tidy

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Characters, and texts, of a slice.
SLICE, TEXTS = 1 << 19, 512


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read on the driver and shipped with the task: executors need no such file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of the ranges that begin at ``starts``, one range after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Codec:
    """The library's processor, and its pieces as bytes."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = sentencepiece_model_pb2.ModelProto.FromString(model)
        rules = spec.normalizer_spec
        self.mark_id = self.library.piece_to_id(MARK)
        self.separable = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and rules.name == "identity" and not spec.trainer_spec.treat_whitespace_as_suffix and not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in spec.pieces) and self.library.id_to_piece(self.mark_id) == MARK
        pieces = [p.piece.replace(MARK, " ").encode() if p.type in (1, 4) else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else None for p in spec.pieces]
        self.plain = np.array([p is not None for p in pieces])
        self.size = np.array([len(p or b"") for p in pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(p or b"" for p in pieces), np.uint8)

    def segmented(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct marked words, in one call of the library."""
        found = self.library.encode([w[1:] for w in words], num_threads=1)
        return [f if len(w) > 1 else [self.mark_id] for w, f in zip(words, found, strict=True)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has)."""
        if not self.separable:
            each = [self.library.encode(t) if t else [] for t in texts]
            return np.array([i for e in each for i in e], np.int32), np.array([len(e) for e in each], np.int64)
        table: dict[str, int] = {}
        codes, counts = [], []
        for t in texts:
            words = CHUNK.findall(MARK + t.replace(" ", MARK)) if t else []
            counts.append(len(words))
            codes.extend(table.setdefault(w, len(table)) for w in words)
        found = self.segmented(list(table))
        size = np.array([len(f) for f in found], np.int64)
        flat = np.fromiter((i for f in found for i in f), np.int32, int(size.sum()))
        code = np.array(codes, np.int64)
        ids = flat[gathered((np.cumsum(size) - size)[code], size[code])] if len(code) else np.zeros(0, np.int32)
        ends = np.r_[0, np.cumsum(size[code])] if len(code) else np.zeros(1, np.int64)
        at = np.r_[0, np.cumsum(counts)].astype(np.int64)
        return ids, np.diff(ends[at])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """As the library's decode(ids) of each text; special or unknown ids and broken byte runs go to the library itself."""
        known = (ids >= 0) & (ids < len(self.plain))
        safe = np.where(known, ids, 0)
        good = known & self.plain[safe]
        size = np.where(good, self.size[safe], 0)
        data = self.bytes[gathered(self.start[safe], size)].tobytes()
        ends, at = np.r_[0, np.cumsum(size)], np.r_[0, np.cumsum(counts)].astype(np.int64)
        whole = np.r_[0, np.cumsum(good)][at]
        out = []
        for a, b, first, last in zip(at[:-1].tolist(), at[1:].tolist(), whole[:-1].tolist(), whole[1:].tolist(), strict=True):
            try:
                if last - first < b - a:
                    raise UnicodeDecodeError("utf-8", b"", 0, 0, "special pieces")
                text = data[ends[a] : ends[b]].decode()
                out.append(text[1:] if text[:1] == " " else text)
            except UnicodeDecodeError:
                out.append(self.library.decode(ids[a:b].tolist()))
        return out


@lru_cache(1)
def codec(model: bytes) -> Codec:
    return Codec(model)


def _list(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype("i4")), pa.array(ids.astype("i4")))


def _flat(ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many each row has) of a column whose null rows, and null ids in rows, count as none."""
    counts = np.array([0 if x is None else len(x) for x in ids.to_pylist()], np.int64) if ids.null_count else np.diff(ids.offsets.to_numpy()).astype(np.int64)
    return ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts


def slices(b: pa.RecordBatch, text: int):
    """The batch in slices of at most SLICE characters and TEXTS rows, or one longer text."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.utf8_length(b.column(text)), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
    at = 0
    while at < b.num_rows:
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, "right"))
        end = min(max(at + 1, end), at + TEXTS)
        yield b.slice(at, end - at)
        at = end


def _with(df: DataFrame, model: bytes, added: list[T.StructField], text: str | None, columns) -> DataFrame:
    """df with more Arrow-computed columns; columns(batch, codec) returns their arrays. One Python worker a task does it all."""
    rest = [c for c in df.columns if c not in {f.name for f in added}]
    schema = T.StructType([*(df.schema[c] for c in rest), *added])

    def run(batches):
        own = codec(model)
        for whole in batches:
            for b in slices(whole, whole.schema.get_field_index(text)) if text else portions([whole], 128):
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), *columns(b, own)], names=schema.names)
            tidy()

    return df.mapInArrow(run, schema)


def _column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def encode(df: DataFrame, model: bytes, text: str = "text", out: str = "token_ids") -> DataFrame:
    """df with ``out`` array<int>: the ids of the whole text, without begin or end ids."""
    return _with(df, model, [T.StructField(out, T.ArrayType(T.IntegerType()))], text, lambda b, own: [_list(*own.encode(_column(b, text).to_pylist()))])


def decode(df: DataFrame, model: bytes, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with ``out`` string: the text of the ids; null ids count as none."""
    return _with(df, model, [T.StructField(out, T.StringType())], None, lambda b, own: [pa.array(own.decode(*_flat(_column(b, ids))), pa.string())])


def round_trip(df: DataFrame, model: bytes, text: str = "text", ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Both at once: df with ``ids`` and the text that they decode to."""

    def both(b: pa.RecordBatch, own: Codec) -> list[pa.Array]:
        found, counts = own.encode(_column(b, text).to_pylist())
        return [_list(found, counts), pa.array(own.decode(found, counts), pa.string())]

    return _with(df, model, [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(out, T.StringType())], text, both)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = round_trip(documents(spark, sf_dir).select("doc_id", "text"), model_bytes())
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
