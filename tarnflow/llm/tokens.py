"""Token ids of whole texts through the tokenizers library, with a bounded memory of words seen before.

The pre-tokenizer of the vocabularies used here never joins text across ASCII white space, so a text's ids are the
ids of its words in order. A word of printable ASCII and Latin-1 letters is cut by the tokenizer's own pattern and
each part goes to the library's BPE model; any other word, and any text with the start of a special token, goes
through the library whole.
"""

from __future__ import annotations

import json
import re
import struct

# Fixed values of the byte-level alphabet: the bytes that stand for themselves; the others follow from U+0100 on.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

# Fixed values of word_bpe_49k.json, for words without white space.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> dict[int, str]:
    out = {b: chr(b) for b in _SELF}
    rest = [b for b in range(256) if b not in out]
    return out | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Parts(dict):
    """Part of a word -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, model, limit: int):
        super().__init__()
        self.model, self.limit, self.letters = model, limit, byte_alphabet()

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        mapped = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        ids = [t.id for t in self.model.tokenize(mapped)]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= 64:
            self[part] = out
        return out


class _Words(dict):
    """UTF-8 word without ASCII white space -> its ids, packed."""

    def __init__(self, tokenizer, limit: int, by_part: bool):
        super().__init__()
        self.tokenizer, self.limit, self.by_part = tokenizer, limit, by_part
        self.parts = _Parts(tokenizer.model, limit)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        text = word.decode()
        if self.by_part and _PLAIN.fullmatch(text):
            out = b"".join(map(self.parts.__getitem__, _PARTS.findall(text.lower())))
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            self[word] = out
        return out


class TextIds:
    """encode(text) gives the packed ids of a text; limit bounds the words kept in memory."""

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        norms = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        known = (steps[0].get("pattern") or {}).get("Regex") == _SPLIT and norms == ["NFC", "Replace", "Lowercase"]
        self.known = known
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.words = _Words(self.tokenizer, limit, known)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.known or any(s in text for s in self.specials):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.words.__getitem__, text.encode().split()))


_SEEN: dict[str, TextIds] = {}


def text_ids(path: str) -> TextIds:
    """One encoder for each worker process and vocabulary."""
    if path not in _SEEN:
        _SEEN[path] = TextIds(path)
    return _SEEN[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))
