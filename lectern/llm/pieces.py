"""SentencePiece encoding with exact source offsets, and decoding.

A text is first normalised: at each place the longest prefix found in the model's compiled
character map is replaced, a character the map does not know is kept, blanks become the piece
blank, and one is put in front. Every normalised byte remembers the source byte it came from, so
any piece, byte pieces included, projects to a span of source bytes. Pieces never reach past a
blank that follows another character (checked when a model is loaded), so segments cut there are
encoded on their own, and those met before come from a bounded memory.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import id_and_text, schema_of, text_slices

BLANK = "▁"
MEMORY = 400_000
LONG_SEGMENT = 200
REPLACEMENT = "�".encode()
SEGMENT = re.compile(rb" +[^ ]+| +$")


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 prefixes, and the pool of their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.pool = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest known prefix of ``text`` from ``at``."""
        if not self.units:
            return None
        def offset(unit):
            return (unit >> 10) << ((unit & 0x200) >> 6)

        best, node = None, offset(self.units[0])
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(self.units) or self.units[node] & 0x800000FF != text[k]:
                break
            unit = self.units[node]
            node ^= offset(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                best = k + 1 - at, self.pool[start:self.pool.index(b"\0", start)]
        return best


class Model:
    """One SentencePiece model file, with the tables the operators need."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rules = spec.normalizer_spec
        if spec.trainer_spec.treat_whitespace_as_suffix or not rules.escape_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("blanks must be escaped and lead their piece, the first one too")
        names = [p.piece for p in spec.pieces]
        if any(BLANK in n.lstrip(BLANK) for n in names) or any(p.type == 4 for p in spec.pieces):
            raise ValueError("pieces of this model reach past a blank")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chars = CharacterMap(rules.precompiled_charsmap)
        self.squeeze = rules.remove_extra_whitespaces
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        kinds = np.array([p.type for p in spec.pieces])
        self.is_byte, self.unknown = kinds == 6, self.library.unk_id()
        self.surface = [n.replace(BLANK, " ").encode() for n in names]
        for i in np.flatnonzero(self.is_byte):
            self.surface[i] = bytes([int(names[i][3:5], 16)])
        for i in np.flatnonzero(kinds == 3):
            self.surface[i] = b""
        self.surface[self.unknown] = " ⁇ ".encode()
        self.sizes = np.array([len(x) for x in self.surface])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(self.surface), np.uint8)
        self.known: dict[bytes, bytes] = {}

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray | None]:
        """Normalised bytes, a blank being one byte, and the source offset of each and of the end (``None``: the same)."""
        blank = BLANK.encode()
        if not self.chars.units and not self.squeeze:
            if blank not in text:
                return text, None
            inside = np.zeros(len(text), bool)
            for m in re.finditer(re.escape(blank), text):
                inside[m.start() + 1:m.end()] = True
            return text.replace(blank, b" "), np.r_[np.flatnonzero(~inside), len(text)]
        out, origin, at = bytearray(), [], 0
        while at < len(text):
            found = self.chars.longest(text, at)
            if found is None:
                width = 1 if text[at] < 0x80 else 2 if text[at] < 0xE0 else 3 if text[at] < 0xF0 else 4
                found = width, text[at:at + width]
            piece = found[1].replace(blank, b" ")
            if self.squeeze and piece == b" " and (not out or out[-1:] == b" "):
                piece = b""
            out += piece
            origin += [at] * len(piece)
            at += found[0]
        while self.squeeze and out[-1:] == b" ":
            del out[-1], origin[-1]
        return bytes(out), np.array([*origin, len(text)])

    def _learn(self, segments: list[bytes]) -> dict[bytes, bytes]:
        """Ids, as little-endian 32-bit integers, of each segment, named without its first blank."""
        encoded = self.library.encode([s.decode() for s in segments], num_threads=1)
        out = {s: array("I", ids).tobytes() for s, ids in zip(segments, encoded, strict=True)}
        if b"" in out:
            out[b""] = array("I", [self.library.piece_to_id(BLANK)]).tobytes()
        return out

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids without begin and end, and the source byte offsets of the piece ends after a leading 0."""
        plain, origin = self.normalise(text)
        if not plain:
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        if b"  " in plain or plain[:1] == b" " or plain[-1:] == b" ":
            segments = [s[1:] for s in SEGMENT.findall(b" " + plain)]
        else:
            segments = plain.split(b" ")
        found = list(map(self.known.get, segments))
        if None in found:
            new = self._learn(list({s for s, f in zip(segments, found, strict=True) if f is None}))
            found = [new[s] if f is None else f for s, f in zip(segments, found, strict=True)]
            if len(self.known) + len(new) > MEMORY:
                self.known.clear()
            self.known.update((k, v) for k, v in new.items() if len(k) <= LONG_SEGMENT)
        ids = np.frombuffer(b"".join(found), "<u4")
        if self.unknown is not None and (ids == self.unknown).any():
            names = [p for s in segments for p in self.library.encode(s.decode(), out_type=str) or [BLANK]]
            sizes = np.array([len(p.replace(BLANK, " ").encode()) for p in names])
        else:
            sizes = self.sizes[ids]
        ends = np.cumsum(sizes) - 1
        if ends[-1] != len(plain):
            raise ValueError("pieces do not cover the normalised text")
        return ids, np.r_[0, ends if origin is None else origin[ends]]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, begin and end left out: surfaces joined, the blank put in front taken off."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ids) else 0
        raw = self.pool[np.arange(total) + np.repeat(self.starts[ids] - ends + sizes, sizes)].tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = self._repair(ids)
        return raw[1:] if len(ids) and raw[:1] == b" " and not self.is_byte[ids[0]] else raw

    def _repair(self, ids: np.ndarray) -> bytes:
        out, run = [], bytearray()
        for i in [*ids.tolist(), self.begin]:
            if self.is_byte[i]:
                run += self.surface[i]
                continue
            out += [_valid(bytes(run)), self.surface[i]]
            run.clear()
        return b"".join(out)


def _valid(run: bytes) -> bytes:
    """A run of byte pieces as UTF-8; each byte that is part of no character becomes U+FFFD."""
    try:
        run.decode()
        return run
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for width in (1, 2, 3, 4):
                try:
                    run[at:at + width].decode()
                except UnicodeDecodeError:
                    continue
                if at + width <= len(run):
                    out.append(run[at:at + width])
                    at += width
                    break
            else:
                out.append(REPLACEMENT)
                at += 1
        return b"".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """A model file loaded once in each process; every executor has the file at ``path``."""
    return Model(path)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).astype(np.int32)))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, ends, decoded: begin id, pieces, end id; the source byte where each id ends; the text decoded again.

    An id starts where the one before it ends, the first at 0, so begin and end have empty spans and
    the last end is the length of the text. A null text counts as empty: begin and end only. Byte
    pieces cover one byte each.
    """
    def task(batches):
        m = model(model_path)
        for ids, texts in text_slices(batches, 1 << 20):
            pieces, ends, decoded = [], [], []
            for t in texts:
                got, cuts = m.encode(t or b"")
                pieces.append(np.r_[m.begin, got, m.end])
                ends.append(np.r_[cuts, cuts[-1]])
                decoded.append(m.decode(got))
            yield pa.RecordBatch.from_arrays(
                [ids, _lists(pieces), _lists(ends), pa.array(decoded, pa.binary()).cast(pa.string())], names=["doc_id", "ids", "ends", "decoded"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        task, schema_of(docs, "ids array<int>, ends array<int>, decoded string", id_col))


def digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 (piece ends after a leading 0) of what ``encode`` gives."""
    def task(batches):
        m = model(model_path)
        begin, end = (np.array([i], "<u4").tobytes() for i in (m.begin, m.end))
        sha = hashlib.sha256
        for ids, texts in text_slices(batches, 1 << 20):
            count, hashed, plain, spans = [], [], [], []
            for t in texts:
                got, cuts = m.encode(t or b"")
                count.append(len(got) + 2)
                hashed.append(sha(begin + got.tobytes() + end).hexdigest())
                plain.append(sha(m.decode(got)).hexdigest())
                spans.append(sha(cuts.astype("<u4").tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(count, pa.int64()), pa.array(hashed, pa.string()), pa.array(plain, pa.string()),
                 pa.array(spans, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        task, schema_of(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string", id_col))


def decode(ids: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of each row's ids; null ids give the empty text."""
    def task(batches):
        m = model(model_path)
        for batch in batches:
            texts = [m.decode(np.array([i for i in row or [] if i is not None], np.int64)) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return ids.select(ids[id_col].alias("doc_id"), ids[ids_col].alias("ids")).mapInArrow(task, schema_of(ids, "text string", id_col))
