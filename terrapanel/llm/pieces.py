"""SentencePiece BPE encoding and decoding from a model file, without the library.

Encoding uses a prefix table. For every prefix of a segment, the table holds the last token of the prefix's
encoding, which is unique: among the vocabulary entries that end there (found by an automaton, longest first), it
is the one that the shorter prefix's last token is compatible with. Two tokens are compatible if encoding
their joined text by merges gives just these two. The ids are then recovered backwards.

This holds for merges that are ranked by the merged piece alone, leftmost first, as here: the first merge across a
token border would also happen in the two tokens alone. Merges never join a word and the space after it, so
the text is cut where a space follows something else; segments are encoded alone and remembered.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator

import ahocorasick

SPACE = "▁"
# Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
LONGEST_KEPT = 48


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message in the protocol-buffer wire format."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            length = {1: 8, 5: 4}.get(kind)
            if length is None:
                length, at = _varint(data, at)
            value, at = data[at : at + length], at + length
        yield tag >> 3, value


class Model:
    """The pieces of a BPE model file that keeps text as it is but for spaces, and spells unknown characters as bytes."""

    def __init__(self, data: bytes):
        self.texts: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer = normalizer = b""
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.texts.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = value
            elif number == 3:
                normalizer = value
        trained, normal = dict(_fields(trainer)), dict(_fields(normalizer))
        if trained.get(3, 1) != 2 or not trained.get(35, 0) or normal.get(2) or normal.get(4, 1):
            raise ValueError("only BPE models with byte fallback and without normalisation are supported")
        if USER_DEFINED in self.types:
            raise ValueError("models with user-defined pieces are not supported")
        self.dummy_prefix = bool(normal.get(3, 1))
        self.begin, self.end = trained.get(41, 1), trained.get(42, 2)
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.types)) if k in (NORMAL, UNUSED)}
        self.bytes = {
            int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.types)) if k == BYTE
        }


class Encoder:
    """Encodes texts, with the ids of segments remembered up to a number of them."""

    def __init__(self, model: Model, most: int = 400_000):
        self.model, self.most = model, most
        self.automaton = ahocorasick.Automaton()
        for text, i in model.ids.items():
            self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        self.step = len(model.texts) + 1
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, bytes]] = {}
        # a space piece is made of spaces only, or starts with one; characters outside the vocabulary stand alone
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
        if any(SPACE in t.lstrip(SPACE) for t in model.ids) or "\n" in "".join(model.ids):
            raise ValueError("pieces with a space or line break inside are not supported")

    def _merged(self, text: str) -> list[str]:
        """Encoding by merges, for pairs of tokens: again and again the best-scored adjacent pair, leftmost first."""
        ids, scores = self.model.ids, self.model.scores
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, one: int, other: int) -> bool:
        """Whether the pieces' joined text is encoded as the two; one below 0: whether merges make the other at all."""
        texts = self.model.texts
        pair = [texts[other]] if one < 0 else [texts[one], texts[other]]
        if len(self.pairs) >= self.most:
            self.pairs.clear()
        found = self.pairs[one * self.step + other] = self._merged("".join(pair)) == pair
        return found

    def _segment(self, text: str) -> list[int]:
        # last token of each prefix and where it starts; -1 is a character outside the vocabulary
        tokens, starts = [-1] * (len(text) + 1), list(range(-1, len(text)))
        pairs, step, done = self.pairs, self.step, -1
        for end, (length, token) in self.automaton.iter(text):  # at each end, longest first
            if end == done:
                continue
            start = end + 1 - length
            before = tokens[start]  # also -1 where nothing is before
            fits = pairs.get(before * step + token)
            if fits is None:
                fits = self._compatible(before, token)
            if fits:
                tokens[end + 1], starts[end + 1], done = token, start, end
        ids: list[int] = []
        at = len(text)
        while at:
            token = tokens[at]
            if token < 0:
                ids.extend(self.model.bytes[b] for b in reversed(text[at - 1].encode()))
            else:
                ids.append(token)
            at = starts[at]
        ids.reverse()
        return ids

    def _packed(self, segment: str) -> bytes:
        found = self.known.get(segment)
        if found is None:
            found = b"".join(i.to_bytes(4, "little") for i in self._segment(segment))
            if len(segment) <= LONGEST_KEPT:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[segment] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers, with begin and end."""
        model = self.model
        ends = [i.to_bytes(4, "little") for i in (model.begin, model.end)]
        if text and model.dummy_prefix:
            text = " " + text
        return ends[0] + b"".join(map(self._packed, self.cut.findall(text.replace(" ", SPACE)))) + ends[1]


class Decoder:
    def __init__(self, model: Model):
        self.model = model
        self.spelled = [
            b""
            if kind == CONTROL
            else bytes([int(text[3:5], 16)])
            if kind == BYTE
            else b" \xe2\x81\x87 "
            if kind == UNKNOWN
            else text.replace(SPACE, " ").encode()
            for text, kind in zip(model.texts, model.types)
        ]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; of the first piece that isn't empty, one leading space goes. Broken UTF-8 from
        byte pieces becomes U+FFFD, byte by byte; a piece without text between byte pieces parts them."""
        model, spelled = self.model, self.spelled
        pieces = list(map(spelled.__getitem__, ids))
        if model.dummy_prefix:
            first = next((k for k, p in enumerate(pieces) if p), None)
            if first is not None and pieces[first][:1] == b" " and model.types[ids[first]] in (NORMAL, UNUSED):
                pieces[first] = pieces[first][1:]
        if b"" not in pieces[1:-1]:
            return _decoded_bytes(b"".join(pieces))
        parts, start = [], 0
        for k, piece in enumerate([*pieces, b""]):
            if not piece:
                parts.append(_decoded_bytes(b"".join(pieces[start:k])))
                start = k + 1
        return "".join(parts)


def _decoded_bytes(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode(errors="one_by_one")


def _one_by_one(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("one_by_one", _one_by_one)
