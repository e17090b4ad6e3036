"""SentencePiece encoding and decoding that keeps source offsets.

A model's compiled character map is a double-array trie of byte strings with
their replacements. ``Normaliser`` walks it for the longest prefix at every
place, and records for every byte written which source byte it came from. The
normalised text is then segmented by a processor made from the same model with
its own normaliser switched off, and the pieces, whose lengths in the
normalised text are known, are projected through the alignment to byte spans
of the source. A model without a map (identity) takes a vectorised way to the
same alignment.
"""

from __future__ import annotations

import functools
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

MARK = "▁"
BAD = "�".encode()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CompiledMap:
    """Longest-prefix lookup in a compiled character map."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob, 0)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, source bytes) of the longest entry that starts at
        ``at``, or None."""
        units = self.units
        node = _offset(units[0])
        found, length = -1, 0
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found, length = units[node] & 0x7FFFFFFF, i - at + 1
        if found < 0:
            return None
        return self.pool[found : self.pool.index(b"\0", found)], length


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


class Normaliser:
    """The model's normalisation, with an alignment to source bytes."""

    def __init__(self, spec, suffix_mark: bool = False, fixed: tuple[str, ...] = ()):
        self.map = CompiledMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze, self.escape, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix_mark
        self.fixed = sorted((x.encode() for x in fixed), key=len, reverse=True)
        self.plain = not self.map and not self.fixed and not self.squeeze and self.escape
        self.space = MARK.encode() if self.escape else b" "

    def text(self, source: str) -> str:
        """The normalised text alone."""
        if not self.plain:
            return self.aligned(source)[0].decode()
        if not source:
            return ""
        body = source.replace(" ", MARK)
        return (body + MARK if self.suffix else MARK + body) if self.prefix else body

    def aligned(self, source: str) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, source byte of each, and of the end)."""
        data = source.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            out = self.text(source).encode()
            raw = np.frombuffer(data, np.uint8)
            body = np.repeat(np.arange(len(data)), np.where(raw == 32, 3, 1))
            if not self.prefix:
                return out, np.append(body, len(data))
            pad = np.full(3, len(data) if self.suffix else 0)
            return out, np.concatenate([body, pad, [len(data)]] if self.suffix else [pad, body, [len(data)]])
        return self._walk(data)

    def _step(self, data: bytes, at: int) -> tuple[bytes, int]:
        for x in self.fixed:
            if data.startswith(x, at):
                return x, len(x)
        if self.map and (hit := self.map.longest(data, at)):
            return hit
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + n], n

    def _walk(self, data: bytes) -> tuple[bytes, np.ndarray]:
        at, end = 0, len(data)
        if self.squeeze:
            while at < end:
                part, n = self._step(data, at)
                if part.strip(b" "):
                    break
                if part != b" " and part:
                    break
                at += n
            if at == end:
                return b"", np.array([end])
        out, align = bytearray(), []

        def put(piece: bytes, source: int) -> None:
            out.extend(piece)
            align.extend([source] * len(piece))

        if self.prefix and not self.suffix:
            put(self.space, at)
        after_space = self.squeeze
        while at < end:
            part, n = self._step(data, at)
            if after_space:
                part = part.lstrip(b" ")
            if part:
                for byte in part:
                    put(self.space if byte == 32 else bytes([byte]), at)
                after_space = part.endswith(b" ")
            at += n
            if not self.squeeze:
                after_space = False
        if self.squeeze:
            while out.endswith(self.space):
                cut = len(out) - len(self.space)
                at = align[cut]
                del out[cut:], align[cut:]
        if self.prefix and self.suffix:
            put(self.space, at)
        return bytes(out), np.array([*align, at])


class Codec:
    """Encoding and decoding with one model."""

    def __init__(self, model_path: str, end: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(model_path, "rb") as f:
            blob = f.read()
        model = pb.ModelProto()
        model.ParseFromString(blob)
        fixed = tuple(p.piece for p in model.pieces if p.type == pb.ModelProto.SentencePiece.USER_DEFINED)
        self.normaliser = Normaliser(model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix, fixed)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=blob)
        bare = model.normalizer_spec
        bare.name, bare.precompiled_charsmap = "identity", b""
        bare.add_dummy_prefix = bare.remove_extra_whitespaces = bare.escape_whitespaces = False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.eos = self.whole.eos_id() if end else -1
        types = np.array([p.type for p in model.pieces])
        self.is_byte = types == pb.ModelProto.SentencePiece.BYTE
        values = np.array([int(p.piece[1:-1], 16) if b else 0 for p, b in zip(model.pieces, self.is_byte)])
        self.is_tail = self.is_byte & (values >= 0x80) & (values < 0xC0)
        self.lengths = np.where(self.is_byte, 1, [len(p.piece.encode()) for p in model.pieces])
        self.lengths[types == pb.ModelProto.SentencePiece.CONTROL] = 0
        self.unknown = self.whole.unk_id()

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = self.inner.encode([self.normaliser.text(t) for t in texts], num_threads=1)
        if self.eos >= 0:
            for ids in out:
                ids.append(self.eos)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids)

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last source byte of every piece. Of the bytes of
        one character that fell back to bytes, the last has its span."""
        norm, align = self.normaliser.aligned(text)
        at = np.asarray(ids, np.int64)
        size = self.lengths[at]
        if (at == self.unknown).any():
            inner = self.inner.encode(norm.decode(), out_type=str)
            size[: len(inner)] = [1 if b else len(p.encode()) for p, b in zip(inner, self.is_byte[at])]
        stop = np.cumsum(size)
        start = stop - size
        tail = self.is_tail[at]
        start = np.maximum.accumulate(np.where(tail, 0, start))
        begin = align[start]
        return begin, np.where(np.append(tail[1:], False), begin, align[stop])


@functools.lru_cache(4)
def codec(model_path: str, end: bool) -> Codec:
    return Codec(model_path, end)


def encode_documents(df: DataFrame, model_path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", end: bool = True, decoded: bool = True) -> DataFrame:
    """Ids, source spans and decoded text of every document.

    Returns (doc_id, ids array<int>, begins array<int>, ends array<int>,
    decoded string, n_bytes int), one row for each row of ``df``; begins and
    ends are byte places in the source; decoded is null without ``decoded``;
    n_bytes are the bytes of the source. One pass, no shuffle.

    A null text is the empty text: its only id is the end id (none without
    ``end``), it decodes to the empty text. Repeated rows each have a row, a
    null doc_id stays null, other columns are not looked at, an empty table
    gives an empty table, a text of any length is encoded whole.
    """
    path = model_path or default_model()

    def make():
        tool = codec(path, end)

        def apply(ids, texts):
            found = tool.encode(texts)
            pairs = [tool.spans(t, x) for t, x in zip(texts, found)]
            begins, ends = (_lists([p[k] for p in pairs]) for k in (0, 1))
            return {"doc_id": ids, "ids": _lists(found), "decoded": [tool.decode(x) for x in found] if decoded else [None] * len(ids), "begins": begins, "ends": ends, "n_bytes": [len(t.encode()) for t in texts]}

        return apply

    return common.map_documents(common.documents(df, id_col, text_col), make, "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string, n_bytes int")


def _lists(rows) -> pa.Array:
    places = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=places[1:])
    flat = np.concatenate([np.asarray(x, np.int32) for x in rows]) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(places), pa.array(flat))


def digest(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes): sizes and
    hashes of what ``encode_documents`` returns; n_bytes is where the last
    span ends, which is the bytes of the source, and those without ids."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.col("n_bytes")).cast("long").alias("n_bytes"),
    )
