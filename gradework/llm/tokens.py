"""Encoding of whole texts with a public tokenizer, one piece of text at a time.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so the joined ids equal those
of the whole text.  Pieces repeat, so each worker keeps the ids of those it has met in two dictionaries
of bounded size: when the younger is full the older is dropped.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries in each of the two dictionaries of a worker.
CACHE_ENTRIES = 350_000

#: Inside a piece: after a plain letter or digit before a stop, comma or line break; after a line break before a plain letter or digit.
#: Other letters may end in a mark once they are normalised, which the tokenizer joins with what follows.
_INNER = re.compile(r"(?<=[0-9A-Za-zÀ-ÖØ-öø-ÿ])(?=[.,\n])|(?<=\n)(?=[0-9A-Za-zÀ-ÖØ-öø-ÿ])")
_TWO_SPACES = re.compile(r"\s\s")
#: Letters that the tokenizers' pre-tokenizers never part and, lower-cased, leave as they are.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_BEFORE_SPACE = re.compile(r"(?<=[^\s\x1c-\x1f])(?= )")


def _stays_a_letter(c: str) -> bool:
    """Whether a letter, composed and lower-cased, still is one letter, so that no mark stands at its end."""
    return len(unicodedata.normalize("NFC", c).lower()) == 1


def struct_packers(width: int):
    """A function that packs a list of ids as little-endian unsigned integers."""
    code = {2: "H", 4: "I"}[width]
    made = [struct.Struct(f"<{n}{code}").pack for n in range(65)]

    def pack(ids: list[int]) -> bytes:
        return made[len(ids)](*ids) if len(ids) < 65 else struct.pack(f"<{len(ids)}{code}", *ids)

    return pack


class _Ids(dict):
    """piece -> ids.  A piece that is not known is looked up among the older ones or encoded, and kept."""

    def __init__(self, encoder: "Encoder", older: dict):
        super().__init__({"": encoder.encode_piece("")})
        self.encoder, self.older = encoder, older

    def __missing__(self, piece: str) -> bytes:
        known = self.older.get(piece)
        if known is None:
            encoder = self.encoder
            # Most new pieces are plain words of ASCII letters.
            if piece.isascii() and piece.isalpha():
                tokens = encoder.tokenize(piece.lower() if encoder.drops_space else encoder.space + piece)
                known = encoder.packed([t.id for t in tokens])
            else:
                known = encoder.encode_piece(piece, self)
        self[piece] = known
        return known


class Encoder:
    """encode(texts): ids as little-endian unsigned integers of ``width`` bytes.

    drops_space: the tokenizer drops white space and never joins what it parts (word_bpe); otherwise a
    blank belongs to the word that follows it (byte_bpe).
    """

    def __init__(self, path: str, drops_space: bool, width: int):
        os.environ["RAYON_NUM_THREADS"] = "1"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenize = self.tokenizer.model.tokenize
        self.drops_space, self.width = drops_space, width
        self.blank = "" if drops_space else " "
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in printable]
        self.alphabet = {b: 256 + k for k, b in enumerate(others)}
        self.table = "".join(chr(self.alphabet.get(b, b)) for b in range(256))  # translating by it misses no character, which costs
        self.space = self.table[32]
        self.packed = struct_packers(width)
        self.known = _Ids(self, {})

    def _whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        """A plain word goes to the tokenizer's model alone, as its other steps leave it whole."""
        if self.drops_space:
            word = word.lower()
        if word.isascii():
            word = word.replace(" ", self.space)
        else:
            word = word.encode().decode("latin-1").translate(self.table)
        return self.packed([t.id for t in self.tokenize(word)])

    def encode_piece(self, piece: str, known: dict | None = None) -> bytes:
        """Ids of a piece with its blank, from those of its parts where it has some."""
        if _PLAIN.fullmatch(piece):
            return self._word(self.blank + piece)
        if known is None or not piece:
            return self._whole(self.blank + piece)
        if piece[-1] in ".," and piece[:-1].isalpha() and (piece[-2].isascii() or _stays_a_letter(piece[-2])):
            return known[piece[:-1]] + self._part(piece[-1], known)
        if _TWO_SPACES.search(self.blank + piece):
            return self._whole(self.blank + piece)
        first, *rest = _INNER.split(piece)
        if not rest or not first:
            return self._whole(self.blank + piece)
        return known[first] + b"".join([self._part(x, known) for x in rest])

    def _part(self, part: str, known: dict) -> bytes:
        """Ids of what has no blank before it, kept under a key that no piece has."""
        key = (part,)
        ids = known.get(key)
        if ids is None:
            ids = known[key] = self._word(part) if _PLAIN.fullmatch(part) else self._whole(part)
        return ids

    def _pieces(self, text: str) -> tuple[str, list[str]]:
        """What comes before the first blank between words, and what follows each, without that blank."""
        if self.drops_space:
            return "", text.replace("\n", " ").replace("\t", " ").split(" ")
        if "  " not in text and "\n " not in text and "\t" not in text and "\r" not in text:
            first, *rest = text.split(" ")
        else:
            first, *rest = _BEFORE_SPACE.split(text)
            rest = [x[1:] for x in rest]
        return first, rest

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            if len(self.known) > CACHE_ENTRIES:
                self.known = _Ids(self, dict(self.known))
            first, rest = self._pieces(text)
            ids = b"".join(map(self.known.__getitem__, rest))
            out.append(self._whole(first) + ids if first else ids)
        return out

    def encode_array(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with ``end_id`` behind, and the texts' offsets in them; null is the empty text.

        Pieces are told apart by Arrow, so only the distinct ones of a batch become Python objects.
        """
        if len(self.known) > CACHE_ENTRIES:
            self.known = _Ids(self, dict(self.known))
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.zeros(len(texts), dtype=bool)
        if self.drops_space:
            lines = pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " ")
        else:
            for space in ("  ", "\n ", "\t", "\r"):
                odd |= pc.match_substring(texts, space).to_numpy(zero_copy_only=False)
            lines = pc.if_else(pa.array(odd), "", texts)
        parts = pc.split_pattern(lines, " ")
        at = parts.offsets.to_numpy().astype(np.int64)
        at, pieces = at - at[0], parts.flatten().dictionary_encode()
        code = pieces.indices.to_numpy().astype(np.int64)
        ids = [self.known[x] for x in pieces.dictionary.to_numpy(zero_copy_only=False).tolist()]  # to_pylist makes a scalar of each
        if not self.drops_space:
            # The first piece of a text has no blank before it; a text with odd white space is one piece.
            first = pieces.dictionary.take(pa.array(code[at[:-1]])).to_pylist()
            whole = [self.encode([text.as_py()])[0] if strange else self._whole(word) if word else b"" for text, strange, word in zip(texts, odd, first)]
            code = code.copy()
            code[at[:-1]] = len(ids) + np.arange(len(whole))
            ids += whole
        # The end id is a piece of its own behind each text.
        code = np.insert(code, at[1:], len(ids))
        ids.append(end_id.to_bytes(self.width, "little"))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        flat = np.frombuffer(b"".join(ids), dtype=f"<u{self.width}")
        n = size[code]
        upto = np.zeros(len(code) + 1, dtype=np.int64)
        np.cumsum(n, out=upto[1:])
        place = np.repeat((np.cumsum(size) - size)[code] - upto[:-1], n)
        place += np.arange(upto[-1])
        return flat[place], upto[at + np.arange(len(at))]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, drops_space: bool, width: int = 4) -> Encoder:
    """The worker's encoder for this file."""
    key = (path, drops_space, width)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, drops_space, width)
    return _ENCODERS[key]
