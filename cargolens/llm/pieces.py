"""SentencePiece BPE encoding that keeps source offsets, and decoding.

Text is normalised by longest prefixes of the model's compiled character map (a double-array trie with a pool
of replacements); every normalised character remembers the byte of the source it came from, and every piece
is projected to a span of source bytes. Pieces are merged by score inside segments no piece can cross, so a
segment that was seen before is looked up.

Defined cases: null and empty texts have the end id only; a text without blanks is one segment of any length;
characters outside the vocabulary become byte pieces, of which the last carries the span; an empty table gives
no rows; columns that clash with result columns are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from .shared import free_name, texts_of

BLANK = "▁"
#: Segments remembered by one task, and the longest of them in characters.
REMEMBERED, LONGEST = 600_000, 48

_NEVER, _LOW = 1 << 62, (1 << 32) - 1


class CharacterMap:
    """The compiled map of a model: longest prefix of UTF-8 bytes to its replacement."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = struct.unpack(f"<{size // 4}I", blob[4:4 + size])
        self.pool = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, length of the prefix) at a byte position, or None."""
        units, found = self.units, None
        if not units:
            return None
        node = self._child(units[0], 0)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node = self._child(unit, node)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        return self.pool[found[0]:self.pool.index(b"\0", found[0])], found[1]

    @staticmethod
    def _child(unit: int, node: int) -> int:
        return node ^ (unit >> 10) << ((unit & 0x200) >> 6)


def _char_size(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Normalizer:
    def __init__(self, spec) -> None:
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = (spec.add_dummy_prefix, spec.remove_extra_whitespaces,
                                                 spec.escape_whitespaces)

    @property
    def plain(self) -> bool:
        """Nothing but blanks is rewritten."""
        return not self.map.units and not self.squeeze and self.escape

    def align(self, text: bytes) -> tuple[str, list[int]]:
        """The normalised text and, for each of its characters and its end, the source byte position."""
        out: list[str] = []
        where: list[int] = []
        at, blank = 0, BLANK if self.escape else " "

        def prefix(i: int) -> tuple[str, int]:
            hit = self.map.longest(text, i)
            if hit is None:
                size = _char_size(text[i])
                return text[i:i + size].decode("utf-8", "replace"), size
            return hit[0].decode(), hit[1]

        if self.squeeze:
            while at < len(text):
                piece, size = prefix(at)
                if piece != " ":
                    break
                at += size
        if at == len(text):
            return "", [at]
        if self.dummy:
            out.append(blank)
            where.append(at)
        after_blank = self.squeeze
        while at < len(text):
            piece, size = prefix(at)
            if after_blank:
                piece = piece.lstrip(" ")
            for c in piece:
                out.append(blank if c == " " else c)
                where.append(at)
            if piece:
                after_blank = piece.endswith(" ")
            after_blank = after_blank and self.squeeze
            at += size
        end = at
        if self.squeeze:
            while out and out[-1] == blank:
                out.pop()
                end = where.pop()
        return "".join(out), [*where, end]


class Encoder:
    """One model, loaded once in each task."""

    def __init__(self, path: str) -> None:
        model = model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != model_pb2.TrainerSpec.BPE:
            raise ValueError("not a BPE model")
        kinds = model_pb2.ModelProto.SentencePiece
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        # Symbols are numbered: 0 is a character outside the vocabulary; a pair's value is its rank and what it makes.
        self.symbols = {c: n for n, c in enumerate(dict.fromkeys(
            [c for p in self.ids for c in p] + list(self.ids)), start=1)}
        self.number_ids = [-1, *(self.ids.get(c, -1) for c in self.symbols)]
        self.number_sizes = [1, *map(len, self.symbols)]
        scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        level = {score: n for n, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.pairs: dict[int, int] = {}
        for piece, score in scores.items():
            for i in range(1, len(piece)):
                a, b = self.symbols.get(piece[:i]), self.symbols.get(piece[i:])
                if a and b:
                    self.pairs[a << 32 | b] = level[score] << 32 | self.symbols[piece]
        self.id_sizes = np.array([len(p.piece) if p.type == kinds.NORMAL else 1 for p in model.pieces])
        self.id_bytes = np.zeros(len(model.pieces), dtype=np.int64)
        self.id_bytes[list(self.bytes.values())] = list(self.bytes)
        self.inside = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.end = model.trainer_spec.eos_id
        self.normalizer = Normalizer(model.normalizer_spec)
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("pieces run across blanks: texts can't be cut into segments")
        # A segment starts at a run of blanks; characters of no longer piece stand alone.
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        self.segments = re.compile(f"[{alone}]|{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" if alone
                                   else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.seen: dict[str, tuple[int, ...]] = {}

    def merge(self, text: str) -> list[int]:
        """Symbols of a segment: again and again the best adjacent pair, ties to the left."""
        pairs_of, symbol = self.pairs.get, self.symbols.get
        parts = [symbol(c, 0) for c in text]
        if len(parts) <= LONGEST:
            pairs = [pairs_of(a << 32 | b, _NEVER) for a, b in zip(parts, parts[1:])]
            while pairs:
                best = min(pairs)
                if best == _NEVER:
                    break
                i = pairs.index(best)
                new = parts[i] = best & _LOW
                del parts[i + 1], pairs[i]
                if i:
                    pairs[i - 1] = pairs_of(parts[i - 1] << 32 | new, _NEVER)
                if i < len(pairs):
                    pairs[i] = pairs_of(new << 32 | parts[i + 1], _NEVER)
            return parts
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        gone = [False] * len(parts)
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0:
                best = pairs_of(parts[i] << 32 | parts[j], _NEVER)
                if best != _NEVER:
                    heapq.heappush(heap, (best, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], gone[j] = best & _LOW, True
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p, out in zip(parts, gone, strict=True) if not out]

    def pieces(self, text: str) -> tuple[int, ...]:
        """Ids of a text that is merged as a whole; characters outside the vocabulary become byte pieces."""
        ids, at = [], 0
        for number in self.merge(text):
            i, size = self.number_ids[number], self.number_sizes[number]
            if i >= 0:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[b] for b in text[at:at + size].encode()]
            else:
                ids.append(self.unknown)
            at += size
        return tuple(ids)

    def segment(self, text: str) -> tuple[int, ...]:
        """As ``pieces``, remembered, and cut further where no piece of the vocabulary can cross."""
        inside = self.inside
        cuts = [i for i in range(1, len(text)) if text[i - 1:i + 1] not in inside]
        if cuts:
            ids: list[int] = []
            for low, high in zip([0, *cuts], [*cuts, len(text)]):
                part = text[low:high]
                ids += self.seen.get(part) or self.remember(part, self.pieces(part))
            return self.remember(text, tuple(ids))
        return self.remember(text, self.pieces(text))

    def remember(self, text: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(text) <= LONGEST:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[text] = ids
        return ids

    def encode_ids(self, normal: str) -> list[int]:
        """Ids of a normalised text."""
        ids: list[int] = []
        known = self.seen.get
        for part in self.segments.findall(normal):
            ids += known(part) or self.segment(part)
        return ids

    def characters(self, ids: np.ndarray) -> np.ndarray:
        """Normalised characters that each id covers; of a character's byte pieces the last has it."""
        sizes, byte = self.id_sizes[ids], self.id_bytes[ids]
        inside = (byte >= 0x80) & (byte < 0xC0)
        goes_on = np.append(inside[1:], False) & (byte >= 0x80)
        sizes[goes_on] = 0
        return sizes

    def encode(self, text: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids with the end id, and the first and past-the-last source byte of each."""
        if self.normalizer.plain:
            source = text.decode("utf-8", "replace")
            normal = (BLANK if self.normalizer.dummy and source else "") + source.replace(" ", BLANK)
            where = None
        else:
            normal, where = self.normalizer.align(text)
        ids = self.encode_ids(normal)
        cuts = np.cumsum(self.characters(np.array(ids, dtype=np.int64)))
        if where is not None:
            at = np.array(where, dtype=np.int64)
        elif source.isascii():
            at = np.arange(len(normal) + 1) - (1 if normal and self.normalizer.dummy else 0)
        else:
            points = np.frombuffer(source.encode("utf-32-le"), dtype=np.uint32)
            widths = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            at = np.concatenate(([0], np.cumsum(widths)))
            if self.normalizer.dummy:
                at = np.concatenate(([0], at))
        at = np.maximum(at, 0)
        ends = at[cuts] if len(cuts) else cuts
        begins = at[np.concatenate(([0], cuts[:-1]))] if len(cuts) else cuts
        ids.append(self.end)
        last = [len(text)]
        return ids, np.concatenate((begins, last)), np.concatenate((ends, last))


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def _library(path: str) -> SentencePieceProcessor:
    return SentencePieceProcessor(model_file=path)


def encode_texts(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """The rows with ids, begins and ends; ``model`` is a path that every executor can read."""
    made = ["ids", "begins", "ends"]
    kept = [c for c in df.columns if c not in (*made, text)]
    last = free_name(df, "_text")
    rows = df.select(*kept, F.col(text).cast("string").alias(last))
    schema = rows.drop(last).schema
    for c in made:
        schema = schema.add(c, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = _encoder(model), pa.list_(pa.int32())
        for batch in batches:
            got = [encoder.encode(t) for t in texts_of(batch.column(len(kept)))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array([g[i] for g in got], kind) for i in range(3))], names=[*kept, *made])

    return rows.mapInArrow(run, schema)


def decode_ids(df: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """The rows with ``decoded``, the library's text of the ids."""
    kept = [c for c in df.columns if c not in ("decoded", ids)]
    last = free_name(df, "_ids")
    rows = df.select(*kept, F.col(ids).alias(last))
    schema = rows.drop(last).schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(model)
        for batch in batches:
            texts = [library.decode(v or []) for v in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())],
                                             names=[*kept, "decoded"])

    return rows.mapInArrow(run, schema)


def digest(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass; token count, digests of ids and decoded text, bytes under the spans."""
    rows = df.select(key, F.col(text).cast("string").alias("_text"))
    schema = rows.drop("_text").schema
    for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"),
                       ("spanned_bytes", "long")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, library = _encoder(model), _library(model)
        for batch in batches:
            made = []
            for t in texts_of(batch.column(1)):
                ids, begins, ends = encoder.encode(t)
                made.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                             hashlib.sha256(library.decode(ids).encode()).hexdigest(), int((ends - begins).sum())))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds))],
                names=schema.names)

    return rows.mapInArrow(run, schema)
