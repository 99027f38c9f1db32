"""Tokens of a byte-level BPE vocabulary file, one blank-separated chunk at a time.

No pre-token of these files holds a blank and no normalisation rule reaches across one, so the
tokens of a text are those of its chunks in turn. Chunks repeat far more often than texts do:
each distinct one is encoded once per worker and then looked up.
"""

from __future__ import annotations

import struct
import unicodedata

#: Entries of the young part of a worker's table. Affects speed and memory only.
CACHE_ENTRIES = 300_000
#: Longer keys (text without blanks) are worked out each time, so the entries bound the bytes too.
LONGEST_KEY = 64

#: The pre-token pattern of the file, and what it takes for a blank (fixed values).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\x09-\x0D\x20\x85\xA0\p{L}\p{N}]+"
#: Up to this code point the pattern's letter and digit classes and lower case are the same in every Unicode
#: version, and a text without combining marks is in composed form.
LAST_PLAIN = "ɏ"


class ChunkEncoder:
    """Ids of chunks; ``whole`` holds pre-tokens proven to be one token, with their id."""

    def __init__(self, tokenizer_json: str, whole: dict[str, bytes]):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.merge = self.tokenizer.model.tokenize
        self.find = regex.compile(PRE_TOKEN).findall
        self.whole = whole
        self.byte_letters = byte_letters()
        self.rest = Remembered(self._merged)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def lowered(self, data: bytes) -> bytes:
        """ASCII capitals lowered, as the vocabulary itself does; not beside special strings (told by case) or
        marks that would first join a capital (U+0300 to U+037F)."""
        return data if b"<|" in data or b"\xcc" in data or b"\xcd" in data else data.lower()

    def ids(self, chunk: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = chunk.decode()
        if text.isascii():
            if text.isalpha():  # the common case
                lower = text.lower()
                return self.whole.get(lower) or self.rest[lower]
        elif max(text) > LAST_PLAIN:
            return id_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if b"<|" in chunk and any(s in chunk for s in self.specials):
            return id_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        lower = text.lower()
        if lower.isalpha():
            return self.whole.get(lower) or self.rest[lower]
        return b"".join([self.whole.get(piece) or self.rest[piece] for piece in self.find(lower)])

    def _merged(self, piece: str) -> bytes:
        # ASCII letters and digits are written as themselves.
        plain = piece.isascii() and piece.isalnum()
        letters = piece if plain else piece.encode().decode("latin-1").translate(self.byte_letters)
        return id_bytes([t.id for t in self.merge(letters)])


class Remembered(dict):
    """What ``make`` gives for a key; ``table[key]`` is the whole interface.

    When the young part is full it becomes the old part, so frequent keys stay and memory is bounded.
    """

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > LONGEST_KEY:
            return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_letters() -> dict[int, int]:
    """The letter that byte-level BPE writes for each byte: itself if printable, else the next from U+0100."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


def whole_tokens(tokenizer_json: str) -> dict[str, bytes]:
    """Vocabulary strings proven to be one token when they stand alone, with their ids.

    The proof runs once, on the driver, and its size is bound by the vocabulary: a string
    counts if it is in normal form, the pattern takes it as one pre-token, and encoding it gives
    exactly its own id.
    """
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    back = {letter: byte for byte, letter in byte_letters().items()}
    pattern, candidates = regex.compile(PRE_TOKEN), {}
    for letters, number in tokenizer.get_vocab(with_added_tokens=False).items():
        word = letters.removesuffix("</w>")
        if word == letters or any(ord(c) not in back for c in word):
            continue
        try:
            text = bytes(back[ord(c)] for c in word).decode()
        except UnicodeDecodeError:
            continue
        normal = text == text.lower() == unicodedata.normalize("NFC", text) and max(text, default="") <= LAST_PLAIN
        if text and normal and (m := pattern.fullmatch(text)) and m.end() == len(text):
            candidates[text] = number
    encoded = tokenizer.encode_batch(list(candidates), add_special_tokens=False)
    return {text: id_bytes(e.ids) for text, e in zip(candidates, encoded, strict=True) if e.ids == [candidates[text]]}


_FORMATS = [f"<{n}I" for n in range(16)]


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(_FORMATS[len(ids)] if len(ids) < len(_FORMATS) else f"<{len(ids)}I", *ids)
