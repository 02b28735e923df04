"""Letters, digits, white space and letter case as the tokenizer libraries know them.

Each library has its own version of the Unicode tables.  They are asked once for
all code points, before a job, so that pre-tokens are cut where they cut them.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import tiktoken
from tokenizers import Regex, normalizers, pre_tokenizers

_CLASSES = (r"\p{L}", r"\p{N}", r"\s")
#: Texts whose code points are all below one of these take a matcher of fewer ranges.
_TIERS = (0xFF, 0xFFFF, sys.maxunicode)


@functools.lru_cache(maxsize=1)
def _everything() -> str:
    return "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF)


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for c in sorted(points):
        if out and out[-1][1] == c - 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


@dataclass(frozen=True)
class Classes:
    """Ranges of code points of letters, digits and white space."""

    letters: tuple[tuple[int, int], ...]
    digits: tuple[tuple[int, int], ...]
    space: tuple[tuple[int, int], ...]


@functools.lru_cache(maxsize=1)
def of_tokenizers() -> Classes:
    found = []
    for c in _CLASSES:
        pieces = pre_tokenizers.Split(Regex(c), "removed", invert=True).pre_tokenize_str(_everything())
        found.append(tuple(_ranges([ord(x) for piece, _ in pieces for x in piece])))
    return Classes(*found)


@functools.lru_cache(maxsize=1)
def of_tiktoken() -> Classes:
    bytes_ = {bytes([i]): i for i in range(256)}
    found = []
    for c in _CLASSES:
        only = tiktoken.Encoding("class", pat_str=c, mergeable_ranks=bytes_, special_tokens={})
        found.append(tuple(_ranges([ord(x) for x in bytes(only.encode_ordinary(_everything())).decode()])))
    return Classes(*found)


def _spelled(ranges: tuple[tuple[int, int], ...], most: int) -> str:
    return "".join(re.escape(chr(a)) + ("" if a == b else "-" + re.escape(chr(min(b, most)))) for a, b in ranges if a <= most)


def splitter(pattern: str, classes: Classes) -> Callable[[str], list[str]]:
    """The matches of a pre-token pattern in a text, its classes spelled out."""

    def compiled(most: int) -> Callable[[str], list[str]]:
        letters, digits, space = (_spelled(r, most) for r in (classes.letters, classes.digits, classes.space))
        out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{digits}]").replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{digits}]")
        out = out.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")
        if r"\p" in out:
            raise ValueError(f"a class that can't be spelled out in {pattern!r}")
        return re.compile(out).findall

    latin, plane, all_ = map(compiled, _TIERS)

    def split(text: str) -> list[str]:
        if text.isascii() or (last := max(text)) <= "\xff":
            return latin(text)
        return plane(text) if last <= "￿" else all_(text)

    return split


@dataclass(frozen=True)
class Lowering:
    """Composed and lowered text as the library gives it; Python's own functions where both agree."""

    lower: dict[int, str]  # code points that the library lowers differently
    odd: str  # a pattern of the code points that it may compose or order differently

    def __call__(self, text: str) -> str:
        if text.isascii() or max(text) <= "\xff":
            return text.lower()
        if not unicodedata.is_normalized("NFC", text) or _odd(self.odd)(text):
            text = normalizers.NFC().normalize_str(text) if _odd(self.odd)(text) else unicodedata.normalize("NFC", text)
        if _odd(_set(self.lower))(text):
            text = "".join(self.lower[ord(c)] if ord(c) in self.lower else c.lower() for c in text)
            return text
        return text.lower()


def _set(points) -> str:
    return f"[{_spelled(tuple(_ranges(list(points))), sys.maxunicode)}]"


@functools.lru_cache(maxsize=8)
def _odd(pattern: str) -> Callable:
    return re.compile(pattern).search


def _each(step, texts: list[str]) -> list[str]:
    return step.normalize_str("\n".join(texts)).split("\n")


@functools.lru_cache(maxsize=1)
def lowering() -> Lowering:
    points = [c for c in _everything() if c != "\n"]
    # Python lowers a capital sigma by what follows; the library letter by letter.
    lower = {ord(c): low for c, low in zip(points, _each(normalizers.Lowercase(), points)) if low != c.lower() or c == "Σ"}
    odd = set()
    for form, step in (("NFC", normalizers.NFC()), ("NFD", normalizers.NFD())):
        odd |= {ord(c) for c, n in zip(points, _each(step, points)) if n != unicodedata.normalize(form, c)}
    # Marks that one side does not know are not put in order; those behind or before a known mark show it.
    marks = [c for c in points if unicodedata.category(c)[0] in "MC" and unicodedata.category(c) != "Co"]
    for before, after in (("a", "̴"), ("aͅ", "")):
        probes = [before + c + after for c in marks]
        odd |= {ord(c) for c, p, n in zip(marks, probes, _each(normalizers.NFD(), probes)) if n != unicodedata.normalize("NFD", p)}
    return Lowering(lower, _set(odd) if odd else "(?!)")
