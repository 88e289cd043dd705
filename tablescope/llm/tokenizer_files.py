"""Public tokenizers' files as pre-token splitters and piece counters.

``load`` takes a file's bytes, read once on the driver, so executors need
the library but not the file. A splitter gives a text's pre-tokens, which
pieces never cross; a counter gives one pre-token's pieces."""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections import Counter

#: Texts of these characters only are in normal form, and Python's lower case and
#: white space are the library's; all others take the library's own steps.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]")
_CACHED = 1 << 17
#: Words of a generation whose ids are kept.
_GENERATION = 1 << 18
#: Whether an array of four-byte integers is little-endian here.
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def load(raw: bytes, kind: str) -> Json | Pieces:
    """``kind``: the file's ending, json (tokenizers) or model (sentencepiece)."""
    return {"json": Json, "model": Pieces}[kind](raw)


class Json:
    """A tokenizers file. Special strings inside texts are special tokens, the library's default."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        self.library = Tokenizer.from_str(raw.decode())
        added = spec.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("added tokens with strip, single_word or normalized flags are not supported")
        self.added = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))
                                or r"(?!)")
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        norms = (spec.get("normalizer") or {}).get("normalizers") or []
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.pattern = None
        if ([n["type"] for n in norms] == ["NFC", "Replace", "Lowercase"] and norms[1]["pattern"] == {"Regex": r"\s+"}
                and len(steps) == 2 and steps[1] == byte_level and steps[0]["type"] == "Split"
                and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
                and r"[^\s\p{L}\p{N}]+" in steps[0]["pattern"]["Regex"]):
            import regex                     # matches never cross white space, so a word's parts are the text's

            self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.parts: dict[str, list[str]] = {}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]    # bytes that stand for themselves
        self.letter = {b: chr(b) for b in visible}
        self.letter |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in self.letter)}

    def _split(self, text: str) -> Counter:
        if self.pattern is None or _PLAIN.search(text):
            text = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
            if self.library.pre_tokenizer is None:
                return Counter([text] if text else [])
            return Counter(t for t, _ in self.library.pre_tokenizer.pre_tokenize_str(text))
        found: Counter = Counter()
        for word, n in Counter(text.lower().split()).items():
            parts = self.parts.get(word)
            if parts is None:
                parts = ["".join(map(self.letter.__getitem__, p.encode())) for p in self.pattern.findall(word)]
                if len(self.parts) >= _CACHED:
                    self.parts.clear()
                self.parts[word] = parts
            for p in parts:
                found[p] += n
        return found

    def split(self, text: str) -> tuple[Counter, int]:
        """How often each pre-token occurs; the number of special tokens."""
        pieces = self.added.split(text)
        if len(pieces) == 1:
            return self._split(text), 0
        found: Counter = Counter()
        for p in pieces:
            found.update(self._split(p))
        return found, len(pieces) - 1

    def count(self, pre_token: str) -> int:
        return len(self.library.model.tokenize(pre_token))


class Ids(dict):
    """Token ids of texts by a tokenizers file, as little-endian 32-bit integers: the library's,
    without added, begin or end tokens, truncation or padding. Texts in normal form are joined
    from their words' ids, each word's kept once it is known: the last ``_GENERATION`` words and
    those of the generation before, from which words still in use are taken over."""

    def __init__(self, raw: bytes):
        super().__init__()
        self.before: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.file = Json(raw)
        self.file.library.no_truncation()
        self.file.library.no_padding()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _GENERATION:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(word)
        if ids is None:
            plain = word.isascii() and word.isalpha()               # one part, of letters that stand for themselves
            ids = self.pieces(word) if plain else b"".join(map(self.part, self.file.pattern.findall(word)))
        self[word] = ids
        return ids

    def part(self, part: str) -> bytes:
        """Ids of a part, which words with other signs around it share."""
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= _GENERATION:
                self.parts.clear()
            ids = self.parts[part] = self.pieces("".join(map(self.file.letter.__getitem__, part.encode())))
        return ids

    def pieces(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.file.library.model.tokenize(letters)]).tobytes() if _LITTLE else \
            b"".join(t.id.to_bytes(4, "little") for t in self.file.library.model.tokenize(letters))

    def of(self, text: str) -> bytes:
        if self.file.pattern is None or _PLAIN.search(text) or self.file.added.search(text):
            ids = self.file.library.encode(text, add_special_tokens=False).ids
            return array("I", ids).tobytes() if _LITTLE else b"".join(i.to_bytes(4, "little") for i in ids)
        return b"".join(map(self.__getitem__, text.lower().split()))


class Pieces:
    """A sentencepiece file whose pieces hold white space only in front."""

    def __init__(self, raw: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto.FromString(raw)
        plain = model.normalizer_spec
        if plain.name != "identity" or plain.remove_extra_whitespaces or not plain.escape_whitespaces or \
                any("▁" in p.piece.lstrip("▁") for p in model.pieces):
            raise ValueError("only models that keep the text and have white space in front of pieces are supported")
        self.prefix = plain.add_dummy_prefix
        plain.add_dummy_prefix = False
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.words = re.compile("[ ▁]*[^ ▁]+|[ ▁]+")

    def split(self, text: str) -> tuple[Counter, int]:
        return Counter(self.words.findall(" " + text if self.prefix and text else text)), 0

    def count(self, pre_token: str) -> int:
        return len(self.library.encode(pre_token))
