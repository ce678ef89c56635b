"""Token ids of whole texts, as the tokenizers' own libraries give them, with pieces of texts remembered by each worker.

Both vocabularies encode a text piece by piece: the byte-level one by its pre-tokens, the other by words with the spaces before them,
since none of its pieces holds a space after another character. A piece's ids are encoded once by the library and kept in a
bounded cache; a text that can't be cut safely is encoded whole. Ids are little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from .tokens import BYTES, TwoTier

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Entries of a worker's cache of pieces, characters of its longest.
CACHE, LONGEST = 1 << 18, 48
#: Pieces encoded by one call, characters of the texts cut together; what parts the pieces of a call: the spelling of byte 0.
GROUP, TOGETHER, BAR_TEXT, BAR = 64, 1 << 20, "\x00", BYTES[0]
SPACE = "▁"  # how the piece vocabulary spells a space


SHORT = [struct.Struct(f"<{n}I").pack for n in range(32)]


def packed(ids: list[int]) -> bytes:
    n = len(ids)
    return SHORT[n](*ids) if n < 32 else struct.pack(f"<{n}I", *ids)


def spelt(piece: str) -> str:
    """A piece as the byte-level vocabulary spells it; of printable ASCII, only the space differs."""
    return piece.replace(" ", BYTES[32]) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(BYTES)


class Known(dict):
    """Piece -> ids, filled by ``encode``. Of two generations, the older one is given up when the newer is full; what is met again moves over."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older, self.size = encode, {}, CACHE

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = packed(self.encode(piece))
        if len(piece) <= LONGEST:
            self.keep(piece, ids)
        return ids

    def keep(self, piece: str, ids: bytes) -> None:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[piece] = ids


class ByteLevel(TwoTier):
    """Ids by a byte-level vocabulary of the tokenizers library. ``plain``: its special strings inside texts are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        super().__init__(path, {})
        if plain:
            self.encode = Tokenizer.from_file(path)  # not the shared one
            self.encode.encode_special_tokens = True
            self.merge, self.special = self.encode.model.tokenize, []
        self.known = Known(self.piece_ids)
        alone = [w for w in self.encode.get_vocab() if BAR in w]
        self.bar = self.encode.token_to_id(BAR) if alone == [BAR] else None

    def piece_ids(self, piece: str) -> list[int]:
        return [t.id for t in self.merge(spelt(piece))]

    def learn(self, new: list[str]) -> None:
        """Encode many pieces with few calls: no merge reaches over a character that no longer word of the vocabulary holds."""
        known, bar = self.known, self.bar
        for a in range(0, len(new), GROUP):
            part = new[a : a + GROUP]
            joined = BAR.join([*map(spelt, part), ""])
            ids = [t.id for t in self.merge(joined)]
            at = 0
            for p in part:
                end = ids.index(bar, at)
                known.keep(p, packed(ids[at:end]))
                at = end + 1

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of many texts."""
        out: list[bytes] = []
        size, held = 0, []
        for text in texts:
            if held and size + len(text) > TOGETHER:
                out += self._many(held)
                size, held = 0, []
            held.append(text)
            size += len(text)
        return out + self._many(held)

    def _many(self, texts: list[str]) -> list[bytes]:
        cut = [self.pieces(t) for t in texts]
        known = self.known
        if self.bar is not None:
            new = [p for p in set().union(*filter(None, cut)) if p not in known and p not in known.older]
            self.learn([p for p in new if len(p) <= LONGEST and BAR_TEXT not in p])
        get = known.__getitem__
        return [b"".join(map(get, p)) if p is not None else packed(self.encode.encode(t, add_special_tokens=False).ids) for t, p in zip(texts, cut, strict=True)]

    def ids(self, text: str) -> bytes:
        return self._many([text])[0]

    def safe(self, text: str) -> bool:
        """Whether the pattern and the library class all characters of a text alike."""
        if text.isascii():
            return True
        chars = set(text)
        self.pieces("".join(chars.difference(self.alike, self.unlike)))  # meets the new ones
        return chars.isdisjoint(self.unlike)

    def spelled(self) -> list[bytes]:
        """The bytes of every id."""
        back = {c: b for b, c in BYTES.items()}
        special = {t.content for t in self.encode.get_added_tokens_decoder().values()}
        words = (self.encode.id_to_token(i) or "" for i in range(self.encode.get_vocab_size()))
        return [w.encode() if w in special else bytes(back[c] for c in w) for w in words]


class Pieces:
    """Ids by a vocabulary of the sentencepiece library that adds a space before the text."""

    WORD = re.compile(" +[^ ]*")

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", name) for name in names)
        self.known = Known(self.word_ids)
        self.names, self.space = names, self.model.piece_to_id(SPACE)

    def word_ids(self, word: str) -> list[int]:
        return self.model.encode(word[1:], num_threads=1) if word != " " else [self.space]

    def ids(self, text: str) -> bytes:
        if not self.by_word or SPACE in text or not text:
            return packed(self.model.encode(text, num_threads=1))
        return b"".join(map(self.known.__getitem__, self.WORD.findall(f" {text}")))

    def many(self, segments: list[str]) -> list[bytes]:
        """Ids of many texts, each given with a space before it."""
        known = self.known
        new = [s for s in segments if s not in known and s not in known.older and 1 < len(s) <= LONGEST]
        for s, ids in zip(new, self.model.encode([s[1:] for s in new], num_threads=1), strict=True):
            known.keep(s, packed(ids))
        return [known.get(s) or (self.ids(s[1:]) if s != " " else known[s]) for s in segments]

    def spelled(self) -> list[bytes]:
        byte = self.model.is_byte
        return [bytes([int(w[3:5], 16)]) if byte(i) else w.replace(SPACE, " ").encode() for i, w in enumerate(self.names)]


@lru_cache(maxsize=2)
def byte_level(vocabulary: str = BYTE_LEVEL, plain: bool = False) -> ByteLevel:
    return ByteLevel(public_tokenizers.path(vocabulary), plain)


@lru_cache(maxsize=1)
def pieces(vocabulary: str = PIECES) -> Pieces:
    return Pieces(public_tokenizers.path(vocabulary))
