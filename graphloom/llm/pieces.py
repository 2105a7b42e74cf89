"""SentencePiece BPE encoding and decoding, exact, by backtracking.

The library merges the best adjacent pair again and again. A sequence of pieces is its result exactly
if every two neighbours, merged alone, stay those two pieces: priorities are fixed by the merged
piece and ties go to the left, so merges inside two neighbours run in the same order as in the whole
text, and a merge across their border would show up in the two alone. So the encoder goes from left
to right over the longest matches that an Aho-Corasick automaton finds, keeps a match only if it is
compatible with the piece before it (checked by re-merging the two, and remembered), takes shorter
matches next, and steps back when none is left. A prefix has one valid encoding, so a position that
failed once has failed for good; a bitfield keeps those positions and no position is tried twice.

A piece holds blanks only in front and never a line feed (checked when the model is read), so merges
don't cross the start of a word or a line: words are encoded alone and remembered by worker.

Null texts count as empty; empty texts give the begin and end ids only. Texts are encoded whole.
Models other than BPE with identity normalisation are refused.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words of each of two generations, and piece pairs, that a worker remembers. Results don't depend on it.
WORDS_KEPT, PAIRS_KEPT = 150_000, 400_000
#: No piece begins here at all; none shorter is left.
NO_PIECE, NONE_LEFT = -2, -1
#: Longer units are encoded without being remembered.
LONGEST_KEPT = 48


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + n], i + n
        yield key >> 3, value


def _one_each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("one_each", _one_each)


class Pieces:
    """A model, read from its file's bytes."""

    def __init__(self, model: bytes) -> None:
        import ahocorasick

        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.dummy_prefix = True
        model_type, charsmap, squeeze = 1, b"", True
        for number, value in _fields(model):
            if number == 1:
                one = dict(_fields(value))
                self.pieces.append(one[1].decode())
                scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
                self.kinds.append(one.get(3, NORMAL))
            elif number == 2:
                model_type = dict(_fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
                charsmap, self.dummy_prefix, squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if not spec.get(5, 1):
                    raise ValueError("a model that doesn't escape blanks")
        if model_type != 2 or charsmap or squeeze or {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("not a BPE model with identity normalisation and normal pieces")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("pieces cross words or lines")
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.letters = {c for p in self.ids for c in p}
        self.singles = {c for c in self.letters if c in self.ids}
        self.bytes = [0] * 256
        for i, kind in enumerate(self.kinds):
            if kind == BYTE:
                self.bytes[int(self.pieces[i][1:-1], 16)] = i
        self.unknown = self.kinds.index(UNKNOWN)
        self.begin, self.end = self.pieces.index("<s>"), self.pieces.index("</s>")
        self.fallback = BYTE in self.kinds
        if self.letters != self.singles:
            raise ValueError("a letter of a piece is no piece itself")
        self.known = re.compile("[" + re.escape("".join(sorted(self.singles))) + "]+")
        self.surface = [self._surface(i) for i in range(len(self.pieces))]
        self.finder = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.finder.add_word(p, i)
        self.finder.make_automaton()
        self.sizes = [len(p) for p in self.pieces]
        self.reach = max(len(p) for p in self.ids)
        # The longest piece that a path through the automaton has passed, and the piece next shorter than a piece.
        self.longest: dict[str, int] = {}
        self.shorter = [NONE_LEFT] * len(self.pieces)
        for p, i in self.ids.items():
            for n in range(1, len(p) + 1):
                held = self.longest.get(p[:n])
                if p[:n] in self.ids:
                    held = self.ids[p[:n]]
                elif held is None and n > 1:
                    held = self.longest.get(p[: n - 1])
                if held is not None:
                    self.longest[p[:n]] = held
            self.shorter[i] = self.longest.get(p[:-1], NONE_LEFT)
        self.pairs: dict[int, bool] = {}

    def _surface(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][1:-1], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else self.pieces[i].replace(SPACE, " ").encode()

    def merged(self, text: str) -> list[str]:
        """What repeated merging makes of a text; for texts of a few letters."""
        parts, score = list(text), self.score.get
        while len(parts) > 1:
            best, at = None, -1
            left = parts[0]
            for i in range(1, len(parts)):
                right = parts[i]
                s = score(left + right)
                if s is not None and (best is None or s > best):
                    best, at = s, i
                left = right
            if best is None:
                break
            parts[at - 1 : at + 1] = [parts[at - 1] + parts[at]]
        return parts

    def _fits(self, before: int, piece: int) -> bool:
        """Whether the two stay as they are when merged alone; before -1 is the start."""
        p = self.pieces[piece]
        out = self.merged(p) == [p] if before < 0 else self.merged(self.pieces[before] + p) == [self.pieces[before], p]
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        self.pairs[before << 20 | piece] = out
        return out

    def _run(self, text: str) -> list[int] | None:
        """Ids of a text; None if some letter of it is no piece."""
        n = len(text)
        pairs, fits, reach, longest, shorter, sizes = self.pairs, self._fits, self.finder.longest_prefix, self.longest, self.shorter, self.sizes
        most = self.reach
        failed = bytearray((n >> 3) + 1)
        path: list[int] = []
        at, before = 0, -1
        window = text[:most]
        piece = longest.get(window[: reach(window)], NO_PIECE)
        while True:
            if piece == NO_PIECE:
                return None
            while piece >= 0:
                end = at + sizes[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    ok = pairs.get(before << 20 | piece)
                    if ok or ok is None and fits(before, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                path.append(piece)
                if end == n:
                    return path
                at, before = end, piece
                window = text[at : at + most]
                piece = longest.get(window[: reach(window)], NO_PIECE)
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = path.pop()
                at -= sizes[piece]
                piece = shorter[piece]
                before = path[-1] if path else -1

    def unit(self, text: str) -> list[int]:
        """Ids of a part of a text that no merge leaves."""
        out = self._run(text)
        if out is None:
            out, done = [], 0
            for m in self.known.finditer(text):
                self._foreign(text[done : m.start()], out)
                out += self._run(m[0])
                done = m.end()
            self._foreign(text[done:], out)
        return out

    def _foreign(self, text: str, out: list[int]) -> None:
        if text and not self.fallback:
            out += [self.unknown] * len(text)
        else:
            out += [self.bytes[b] for b in text.encode()]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; a byte that is no part of a valid sequence becomes U+FFFD."""
        return self.decoded(b"".join(map(self.surface.__getitem__, ids)))

    def decoded(self, surface: bytes) -> str:
        text = surface.decode("utf-8", "one_each")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


class _Words(dict):
    """(ids as little-endian unsigned 32-bit integers, decoded bytes) by unit, filled on demand.

    A unit is a word without the blank before it, or a line feed and the word after it.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.model = pieces
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def __missing__(self, unit: str) -> tuple[bytes, bytes]:
        out = self.older.get(unit)
        if out is not None:
            self[unit] = out
            return out
        ids = self.model.unit(unit if unit[:1] == "\n" else SPACE + unit)
        out = struct.pack(f"<{len(ids)}I", *ids), b"".join(map(self.model.surface.__getitem__, ids))
        if len(unit) <= LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.older = dict(self)
                self.clear()
            self[unit] = out
        return out


    def forget(self) -> None:
        self.older = {}
        self.clear()


class Encoder:
    """Encodes whole texts with a model, remembering words."""

    UNIT = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*|^[^{SPACE}\n]+")

    def __init__(self, model: bytes) -> None:
        self.pieces = Pieces(model)
        self.words = _Words(self.pieces)

    def units(self, text: str) -> list[str]:
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or not self.pieces.dummy_prefix:
            text = (SPACE if self.pieces.dummy_prefix else "") + text.replace(" ", SPACE)
            return [u[1:] if u[0] == SPACE else u for u in self.UNIT.findall(text)]
        first, *rest = text.replace("\n", " \n").split(" ") if text[0] != "\n" else ["", *text.replace("\n", " \n").split(" ")[1:]]
        return [first, *rest]

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """(ids without begin and end, as bytes; decoded bytes before the first blank goes)."""
        if not text:
            return b"", b""
        found = list(map(self.words.__getitem__, self.units(text)))
        return b"".join([f[0] for f in found]), b"".join([f[1] for f in found])


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """This process's encoder for the model."""
    key = hashlib.sha256(model).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def default_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def encode(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", outputs: str = "all", batch: int = 64) -> DataFrame:
    """(id, ids, n_tokens, ids_sha256, decoded, decoded_sha256) for each row of df; one pass, no shuffle.

    outputs "ids" leaves decoded out and "digest" ids too, so that whole texts don't travel back.
    The model's bytes (half a megabyte) go with the function to the executors.
    """
    short_batches(df.sparkSession)
    whole, with_ids = outputs == "all", outputs in ("all", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        begin, end = struct.pack("<I", enc.pieces.begin), struct.pack("<I", enc.pieces.end)
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                ids, texts = [], []
                for text in part.column(1).to_pylist():
                    words, surface = enc.encode(text)
                    ids.append(begin + words + end)
                    texts.append(enc.pieces.decoded(surface))
                out = {
                    "id": part.column(0),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
                }
                if with_ids:
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                    flat = np.frombuffer(b"".join(ids), dtype="<i4")
                    out |= {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}
                if whole:
                    out["decoded"] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
        enc.words.forget()  # a worker waits for its next task with little memory

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * whole
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), default_model(), outputs="digest")
