"""Word shingles as 64-bit hashes, with numpy; whole texts, block by block.

Words are runs of letters, marks, digits and underscores, in lower case, by
Unicode's classes: punctuation, symbols and spaces of any script end a word.
Each letter of a script written without spaces (Chinese characters, Kana, Thai,
Lao, Khmer, Burmese) is a word. A text that has no word but other characters has
its runs of non-space characters as words; an empty or blank text has none. A
text of fewer words than a shingle has one shingle, of all its words."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

WORDS = 5
#: Characters hashed at a time; blocks end at white space.
BLOCK = 1 << 20

_U = np.uint64
_BYTE, _PLACE = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])
_NO_SPACE = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])
_powers = np.ones(1, _U)
#: ASCII and Latin letters: texts of these alone need no look at Unicode's classes.
_OTHER = re.compile("[^\x00-\x7f\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]")
_UNSPACED = re.compile("(CJK|HIRAGANA|KATAKANA|BOPOMOFO|THAI|LAO|KHMER|MYANMAR|YI SYLLABLE|TIBETAN) ")


class _Borders(dict):
    """What a character beyond ASCII stands for between words: a space, itself as a word, or itself."""

    def __missing__(self, code: int) -> str:
        letter = chr(code)
        kind = unicodedata.category(letter)
        if code < 128 or kind[0] in "LN" and not _UNSPACED.match(unicodedata.name(letter, "")) or kind[0] == "M" or kind == "Cf":
            out = letter
        else:
            out = f" {letter} " if kind[0] in "LN" else " "
        self[code] = out
        return out


_borders = _Borders()


def bordered(text: str) -> str:
    """The text with spaces where its words end or begin."""
    return text if text.isascii() or not _OTHER.search(text) else text.translate(_borders)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's last steps)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, _U), np.cumprod(np.full(max(n, 64), _BYTE))])
    return _powers


def _hashed(raw: np.ndarray, kind: np.ndarray) -> np.ndarray:
    inside = kind[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    if not len(edges):
        return np.empty(0, _U)
    sizes = edges[1::2] - edges[::2]
    first = np.cumsum(sizes) - sizes
    place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
    powers = _powers_to(int(sizes.max()))
    return mixed(np.add.reduceat((raw[inside].astype(_U) + _U(1)) * powers[place], first))


def blocks(text: str):
    """The text in pieces of about ``BLOCK`` characters that end at white space."""
    at = 0
    while len(text) - at > BLOCK:
        space = re.compile(r"\s").search(text, at + BLOCK)
        end = space.end() if space else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(text: str) -> np.ndarray:
    for kind, spaced in ((_IN_WORD, bordered), (_NO_SPACE, str)):
        found = np.concatenate([_hashed(np.frombuffer(spaced(b.lower()).encode("utf-8", "replace"), np.uint8), kind) for b in blocks(text)])
        if len(found):
            return found
    return found


def of_words(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """One hash per shingle, in text order, repeats included."""
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, _U(size))
    for j in range(size):
        total = total * _PLACE + words[j:len(words) - size + 1 + j]
    return mixed(total)


def shingles(text: str, size: int = WORDS) -> np.ndarray:
    return of_words(word_hashes(text), size)
