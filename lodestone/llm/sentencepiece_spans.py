"""SentencePiece BPE encoding that keeps byte spans of the original text, and decoding.

Normalisation is done here: at each place it takes the longest prefix that the model's compiled
character map has (a double-array trie), or else one character, and records for every byte of the
normalised text where in the source it came from. The library merges the normalised text into pieces,
its own normalisation turned off in a copy of the model. Projecting each piece's normalised bounds
through the record gives its source span.

Edge cases: null and empty texts give no ids and decode to an empty text; characters outside the
vocabulary become byte pieces, of which the last spans the character; repeated rows get equal
results; an empty table gives no rows; other columns are ignored. The vocabulary file is a parameter
and is read on each executor.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, texts_of

SPACE = "▁"
MARK = len(SPACE.encode())
# Piece types of the public model format.
UNKNOWN, CONTROL, USER_DEFINED, BYTE = 2, 3, 4, 6

codecs.register_error("one_byte_each", lambda e: ("�", e.start + 1))


class CharacterMap:
    """A compiled character map: the size of a double-array trie, the trie's 32-bit units, then zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix of data[at:] that the map has."""
        if not self.units:
            return None
        offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node, found = offset(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units) or (unit := self.units[node]) & 0x800000FF != data[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if not found:
            return None
        return found[0], self.texts[found[1] : self.texts.index(0, found[1])]


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as formats

        proto = formats.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rules = proto.normalizer_spec
        self.prefix, self.squeeze, self.escape = rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces
        self.suffix, self.map = proto.trainer_spec.treat_whitespace_as_suffix, CharacterMap(rules.precompiled_charsmap)
        self.surfaces: list[bytes] = []
        sizes, own, self.spaceless = [], [], set()
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.spaceless.add(i)
                self.surfaces.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type in (UNKNOWN, CONTROL):
                self.spaceless.add(i)
                self.surfaces.append((proto.trainer_spec.unk_surface or " ⁇ ").encode() if p.type == UNKNOWN else b"")
            else:
                own += [p.piece] * (p.type == USER_DEFINED)
                self.surfaces.append(p.piece.replace(SPACE, " ").encode())
            sizes.append(1 if p.type == BYTE else len(p.piece.encode()))
        #: Normalised bytes that each id stands for; without byte pieces an unknown one has no fixed size.
        self.sizes, self.fixed = np.array(sizes, np.int64), proto.trainer_spec.byte_fallback
        self.own = re.compile("|".join(map(re.escape, sorted(own, key=len, reverse=True)))) if own else None
        self.plain = not (self.map.units or self.squeeze or self.suffix or self.own) and self.prefix and self.escape
        rules.precompiled_charsmap, rules.name = b"", "identity"
        rules.add_dummy_prefix = rules.remove_extra_whitespaces = rules.escape_whitespaces = False
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each byte of it and its end the source byte it came from."""
        data, at, out, source = text.encode("utf-8", "surrogatepass"), 0, [], []
        space = SPACE.encode() if self.escape else b" "

        def step(i: int) -> tuple[bytes, int]:
            if self.own and (m := self.own.match(data[i:].decode("utf-8", "ignore"))):
                return m[0].encode(), len(m[0].encode())
            if got := self.map.longest(data, i):
                return got[1], got[0]
            n = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
            return data[i : i + n], n

        def put(piece: bytes, origin: int) -> None:
            out.append(piece)
            source.extend([origin] * len(piece))

        if self.squeeze:
            while at < len(data):
                piece, n = step(at)
                if piece != b" ":
                    break
                at += n
        if at == len(data):
            return "", np.array([0], np.int64)
        if self.prefix and not self.suffix:
            put(space, at)
        before = self.squeeze
        while at < len(data):
            piece, n = step(at)
            while before and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                for c in re.findall(b" |[^ ]+", piece):
                    put(space if c == b" " else c, at)
                before = piece.endswith(b" ")
            at += n
            before = before and self.squeeze
        end = len(data)
        if self.squeeze:
            while out and out[-1] == space:
                end = source[-1]
                del source[len(source) - len(out.pop()) :]
        if self.prefix and self.suffix:
            put(space, end)
        return b"".join(out).decode("utf-8", "surrogatepass"), np.array([*source, end], np.int64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text the ids, and the source bytes where each one's span starts and ends."""
        plain = [self.plain and SPACE not in t for t in texts]
        normal = [(SPACE + t.replace(" ", SPACE) if t else "", None) if p else self.normalise(t) for t, p in zip(texts, plain)]
        return [self._projected(t, *n, ids) for t, n, ids in zip(texts, normal, self.merger.encode([n[0] for n in normal], num_threads=1))]

    def _projected(self, text: str, normalised: str, source: np.ndarray | None, ids: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not ids:
            return (np.zeros(0, np.int32),) * 3
        found = np.array(ids, np.int32)
        if self.fixed:
            bounds = np.concatenate([[0], self.sizes[found].cumsum()])
        else:
            pieces = self.merger.encode(normalised, return_type="proto").pieces
            bounds = np.array([0, *(p.end for p in pieces)])  # bytes of the normalised text
        if source is None:
            # Only spaces changed: every byte of an escaped space comes from that space, any other byte from the start of its character.
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            first = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(len(data), dtype=np.int32), 0))
            source = np.concatenate([np.zeros(MARK, np.int32), np.repeat(first, np.where(data == 32, MARK, 1)), np.array([len(data)], np.int32)])
        origin = source[bounds].astype(np.int32)
        return found, origin[:-1], origin[1:]

    def decode(self, ids) -> str:
        """The text of ids: spaces for their marks, bytes joined to characters (a byte that fits nowhere is U+FFFD), the added first space gone."""
        surfaces = self.surfaces
        parts = [surfaces[i] for i in ids]
        first = next((k for k, p in enumerate(parts) if p), None)
        if self.prefix and not self.suffix and first is not None and parts[first][:1] == b" " and ids[first] not in self.spaceless:
            parts[first] = parts[first][1:]
        return b"".join(parts).decode("utf-8", "one_byte_each")


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model per Python worker."""
    return PieceModel(path)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), pa.int32()))


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids, begins, ends (source byte spans) for every row of docs (doc_id, text); with `decoded` also the ids' text, decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for b in slices(batches, "text", most_bytes=1 << 20):
            got = pieces.encode(texts_of(b, "text"))
            columns, names = [b.column("doc_id"), *(_lists([g[i] for g in got]) for i in range(3))], ["doc_id", "ids", "begins", "ends"]
            if decoded:
                columns, names = [*columns, pa.array([pieces.decode(g[0].tolist()) for g in got], pa.string())], [*names, "text"]
            yield pa.record_batch(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, begins array<int>, ends array<int>" + ", text string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the decoded text for every row of encoded (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                column = part.column("ids")
                flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
                texts = [pieces.decode(flat[i:j].tolist()) for i, j in zip(offsets, offsets[1:])]
                yield pa.record_batch([part.column("doc_id"), column, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, ids array<int>, text string")


def digests(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs; with `ids` also the ids."""
    done = encode(docs, path, decoded=True)
    text = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *(["ids"] if ids else []), F.sha2(text, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_path())


QUERIES = {"op4_sentencepiece": op4_sentencepiece}
ORACLES: dict[str, str] = {}
