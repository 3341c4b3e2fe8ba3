"""SentencePiece models: their pieces in an Aho-Corasick automaton that drives one pass over the text.

At every place of the text the automaton follows its output links through all pieces that end there, longest
first, and each of them relaxes the place's entry in a table of prefixes. For a unigram model the entry is the
best sum of scores (Viterbi). For a BPE model it is the last token of the prefix's encoding: exactly one
piece fits, the one that merging would leave next to the last token of the prefix before it. Either way the
table holds the encoding of every prefix.

No piece of the usual models reaches from a character into a following blank, so a text falls apart into
units, each a run of blanks and what follows up to the next blank, that are encoded one by one. Units are
remembered by the worker, so that a frequent word passes through the automaton once, and a batch of texts asks for each different unit once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import Generic, TypeVar

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ranges, remembered, text_bytes

#: Fixed values of the SentencePiece format: the sign for a blank, model and piece types, the penalty of unknowns.
BLANK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNKNOWN_PENALTY = 10.0
UNKNOWN_SURFACE = " ⁇ "

#: Units a worker remembers, in each of two generations; longer units are not remembered. Both together are some 80 MB, and
#: an executor has several workers.
REMEMBERED, LONGEST = 150_000, 64

_UNITS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")

V = TypeVar("V")


class Remembered(dict[str, V], Generic[V]):
    """A dictionary that computes missing values and keeps a bounded number of them."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.old = compute, {}

    def __missing__(self, unit: str) -> V:
        value = self.old.get(unit)
        if value is None:
            value = self.compute(unit)
        if len(unit) <= LONGEST:
            self[unit] = value
        return value

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()


class PieceModel:
    """A model read from the bytes of a ``.model`` file."""

    def __init__(self, serialized: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(serialized)
        spec, cleaning = proto.trainer_spec, proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are read")
        if cleaning.precompiled_charsmap or cleaning.remove_extra_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError("models that change the text before encoding it are not read")
        if kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not read")
        self.bpe = spec.model_type == BPE
        self.dummy_prefix = cleaning.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.unknown = spec.unk_id
        self.unknown_score = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.byte_ids = [0] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:-1], 16)] = i
        self.byte_fallback = BYTE in kinds
        self.splits = not any(re.search(f"[^{BLANK}]{BLANK}", piece) for piece in self.ids)
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        surfaces = [self._surface(p) for p in proto.pieces]
        starts = np.cumsum([0, *map(len, surfaces)])
        self.surface_table = np.frombuffer(b"".join(surfaces), np.uint8), starts
        self._pairs: dict[tuple[str, str], bool] = {}
        self._alone: dict[str, bool] = {}
        self.unit_ids: Remembered[bytes] = Remembered(self._ids_of_unit)
        self.unit_counts: Remembered[int] = Remembered(lambda unit: self.prefix_counts(unit)[-1])

    @staticmethod
    def _surface(piece) -> bytes:
        if piece.type == BYTE:
            return bytes([int(piece.piece[3:-1], 16)])
        if piece.type == UNKNOWN:
            return UNKNOWN_SURFACE.encode()
        return b"" if piece.type == CONTROL else piece.piece.replace(BLANK, " ").encode()

    # --- one unit -----------------------------------------------------------------------------------------

    def prefixes(self, unit: str) -> list[str]:
        """Last token of the encoding of every prefix, by the prefix's length; entry 0 is empty."""
        return self._bpe_prefixes(unit) if self.bpe else self._best_prefixes(unit)

    def _ends(self, unit: str) -> list[list[str]]:
        """Pieces that end at every place, longest first; a character that is no piece stands for itself."""
        ends: list[list[str]] = [[] for _ in range(len(unit) + 1)]
        for last, piece in self.automaton.iter(unit):
            ends[last + 1].append(piece)
        for at, char in enumerate(unit, 1):
            if char not in self.ids:
                ends[at].append(char)
        return ends

    def _best_prefixes(self, unit: str) -> list[str]:
        scores, best, last = self.scores, [0.0], [""]
        for at, pieces in enumerate(self._ends(unit)[1:], 1):
            top, chosen = -np.inf, ""
            for piece in pieces:
                score = best[at - len(piece)] + scores.get(piece, self.unknown_score)
                if score > top:
                    top, chosen = score, piece
            best.append(top)
            last.append(chosen)
        return last

    def _bpe_prefixes(self, unit: str) -> list[str]:
        last, pairs, alone = [""], self._pairs, self._alone
        for at, pieces in enumerate(self._ends(unit)[1:], 1):
            for piece in pieces:
                before = last[at - len(piece)]
                if before:
                    fits = pairs.get((before, piece))
                    if fits is None:
                        fits = pairs[before, piece] = self.merged(before + piece) == [before, piece]
                else:
                    fits = alone.get(piece)
                    if fits is None:
                        fits = alone[piece] = self.merged(piece) == [piece]
                if fits:
                    last.append(piece)
                    break
            else:
                raise ValueError(f"no piece ends {unit[:at]!r}")
        if len(pairs) > 4 * REMEMBERED:
            pairs.clear()
        return last

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: merge the neighbours that make the best piece, the leftmost of equals."""
        parts = list(text)
        while True:
            best, where = -np.inf, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and score > best:
                    best, where = score, i
            if where < 0:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def tokens(self, unit: str) -> list[str]:
        last, at, found = self.prefixes(unit), len(unit), []
        while at:
            found.append(last[at])
            at -= len(last[at])
        return found[::-1]

    def _cost(self, token: str) -> int:
        """Ids of a token: one, or one per byte of a character that no piece writes."""
        return 1 if token in self.ids or not self.byte_fallback else len(token.encode(errors="replace"))

    def prefix_counts(self, unit: str) -> list[int]:
        """Number of ids of every prefix of a unit."""
        counts = [0]
        for at, token in enumerate(self.prefixes(unit)[1:], 1):
            counts.append(counts[at - len(token)] + self._cost(token))
        return counts

    def _ids_of_unit(self, unit: str) -> bytes:
        ids: list[int] = []
        for token in self.tokens(unit):
            if token in self.ids:
                ids.append(self.ids[token])
            elif self.byte_fallback:
                ids.extend(self.byte_ids[b] for b in token.encode(errors="replace"))
            elif not ids or ids[-1] != self.unknown:  # neighbouring unknowns are one
                ids.append(self.unknown)
        return np.array(ids, "<i4").tobytes()

    # --- whole texts --------------------------------------------------------------------------------------

    def units(self, text: str) -> Iterable[str]:
        if not text:
            return []
        plain = text.replace(" ", BLANK)
        if self.dummy_prefix:
            plain = BLANK + plain
        return _UNITS.findall(plain) if self.splits else [plain]

    def unit_table(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(first unit of each text, n + 1 places; number of every unit; the different units) of several texts.

        Arrow finds the different units, so that Python looks at each of them once.
        """
        plain = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), BLANK, " ")
        if self.dummy_prefix:
            some = pc.greater(pc.binary_length(plain), 0)
            plain = pc.binary_join_element_wise(pc.if_else(some, " ", "").cast(pa.large_string()), plain, pa.scalar("", pa.large_string()))
        data, offsets = text_bytes(plain)
        begins = np.zeros(len(data) + 1, bool)
        if self.splits:
            blank = data == 0x20
            begins[:-1] = blank
            begins[1:-1] &= ~blank[:-1]
        begins[offsets[:-1]] = True
        begins[-1] = False
        starts = np.flatnonzero(begins)
        places = np.r_[starts, len(data)]
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data.tobytes()))
        coded = units.dictionary_encode()
        different = [x.replace(" ", BLANK) for x in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        return np.searchsorted(starts, offsets), coded.indices.to_numpy(zero_copy_only=False), different

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, n + 1 places where those of each text begin)."""
        first, number, units = self.unit_table(texts)
        coded = [self.unit_ids[x] for x in units]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        ids, starts, counts = np.frombuffer(b"".join(coded), "<i4"), np.cumsum(lengths) - lengths, lengths[number]
        return ids[ranges(starts[number], counts)], np.r_[0, np.cumsum(counts)][first]

    def count_all(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of every text."""
        first, number, units = self.unit_table(texts)
        counts = np.fromiter((self.unit_counts[x] for x in units), np.int64, len(units))
        return np.diff(np.r_[0, np.cumsum(counts[number])][first])

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian signed 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()))[0].astype("<i4").tobytes()

    def count(self, text: str | None) -> int:
        return int(self.count_all(pa.array([text], pa.string()))[0])

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement signs."""
        return self.decode_all(ids, np.array([0, len(ids)]))[0].tobytes().decode(errors="replace")

    def trim(self) -> None:
        self.unit_ids.trim()
        self.unit_counts.trim()

    def decode_all(self, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, n + 1 places where each begins) of their ids. The added first blank is taken off."""
        flat, starts = self.surface_table
        lengths = np.diff(starts)[ids]
        data = flat[ranges(starts[ids], lengths)]
        at = np.r_[0, np.cumsum(lengths)][places]
        if self.dummy_prefix:
            first = at[:-1][np.diff(at) > 0]
            extra = np.zeros(len(data), bool)
            extra[first] = data[first] == 0x20
            at = at - np.r_[0, np.cumsum(extra)][at]
            data = data[~extra]
        return data, at

    def counts_by_prefix(self, text: str | None) -> np.ndarray:
        """Number of ids of ``text[:n]`` for every n from 0 to the length of the text."""
        table, total = [np.zeros(1, np.int64)], 0
        for number, unit in enumerate(self.units(text or "")):
            own = np.array(self.prefix_counts(unit)[1:], np.int64)
            # The blank in front of the text belongs to no prefix.
            table.append(total + (own[1:] if self.dummy_prefix and not number else own))
            total += int(own[-1])
        return np.concatenate(table)


def model(serialized: bytes, _kept: dict[int, PieceModel] = remembered("pieces")) -> PieceModel:
    """The model of these bytes, made once in a worker."""
    key = hash(serialized)
    if key not in _kept:
        _kept.clear()
        _kept[key] = PieceModel(serialized)
    return _kept[key]
