"""Exact batch encoding with the ``tokenizers`` library, one call per distinct piece.

A tokenizer whose pre-tokenizer never joins what stands before a space to what follows may encode
the parts of a text one by one. Two such families are recognised from the tokenizer's own file:

* byte-level with the usual pattern (``prefix``): a part is a word with the space before it. Cuts
  are made only at a space between two characters that are no white space, where the pattern always
  starts a new piece.
* white space dropped (``drop``): every space is a cut.

Texts of plain characters only (printable ASCII, tab, line ends, the letters of Latin-1), on which
normal forms change nothing but case, are cut further, into the very pieces of the family's pattern;
those go straight to the model's merges. Any other tokenizer gets whole texts. Special strings hold
no white space in either family (this is checked), and texts with one of their first two characters
are not cut into pieces, so the library's own handling of them is kept.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

_TOUCHING = re.compile(r" (?=\s)|(?<=\s) ")
_CUT = re.compile(r"(?<=\S)(?= \S)")
_PLAIN = re.compile("[\\t\\n\\r -~À-ÖØ-öø-ÿ]*")
#: The families' patterns for plain characters (in ``drop``, of lower case), the likeliest pieces first.
_PIECES = {
    "prefix": re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+"),
    "drop": re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-zß-öø-ÿ0-9]+"),
}
#: Pre-tokenizer patterns that drop white space, as found in tokenizer files.
_DROP_PATTERNS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}

#: Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others in order
#: for the characters from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}


def family(spec: dict) -> str:
    """``prefix``, ``drop`` or ``whole``: where a text may be cut under this tokenizer file."""
    if any(t["content"].split() != [t["content"]] or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens") or []):
        return "whole"
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "prefix"
    steps = pre.get("pretokenizers") or []
    if steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert"):
        kinds = {n.get("type") for n in (norm or {}).get("normalizers", [])}
        if steps[0]["pattern"].get("Regex") in _DROP_PATTERNS and kinds <= {"NFC", "Replace", "Lowercase"}:
            return "drop"
    return "whole"


class _Pieces(dict):
    """Values by piece; one that is missing is made on the way. About ``most`` are kept: of a full
    cache's misses only those met twice, and a cache that then serves badly is emptied."""

    def __init__(self, make: Callable, most: int) -> None:
        self.make, self.most = make, most
        self.once: set = set()
        self.missed = 0

    def __missing__(self, piece: str):
        value = self.make(piece)
        if len(self) < self.most or piece in self.once and len(self) < 1.2 * self.most and len(piece) <= 64:
            self[piece] = value
        else:
            self.missed += 1
            self.once.add(piece)
            if len(self.once) > self.most:
                self.once.clear()
            if self.missed > 8 * self.most:
                self.clear()
                self.missed = 0
        return value


class WordEncoder:
    """``ids(texts)`` gives little-endian unsigned ids as bytes for each text, ``counts(texts)``
    their number.

    The values of about ``words`` pieces are kept. Long texts are handled in segments of about ``segment`` characters, cut where
    the family allows."""

    def __init__(self, path: str, width: int = 4, words: int = 800_000, segment: int = 1 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.family = family(spec)
        self.marks = {t["content"][:2] for t in spec.get("added_tokens") or []}
        self.code = {2: "H", 4: "I"}[width]
        self.words, self.segment = words, segment
        self._kept: dict = {}
        self._made: _Pieces | None = None

    def _encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _segments(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > self.segment and self.family != "whole":
            at = text.find(" ", start + self.segment)
            while at > 0 and at + 1 < len(text) and (text[at - 1].isspace() or text[at + 1].isspace()):
                at = text.find(" ", at + 1)
            if at < 0 or at + 1 >= len(text):
                break
            yield text[start:at]
            start = at
        yield text[start:] if start else text

    def _plain(self, text: str) -> list[str] | None:
        """The pattern's pieces of a plain text; None if it is not plain."""
        if _PLAIN.fullmatch(text) is None or any(m in text for m in self.marks):
            return None
        return _PIECES[self.family].findall(text.lower() if self.family == "drop" else text)

    def _parts(self, text: str) -> tuple[str, list[str]]:
        """The first part, and those that follow a space (in ``prefix`` with it)."""
        if self.family == "drop":
            return "", text.replace("\n", " ").split(" ")
        if " \n" not in text and "\n " not in text and "  " not in text and text.replace("\n", "").isprintable() or _TOUCHING.search(text) is None:
            first, *later = text.split(" ")
            return first, [" " + w for w in later]
        first, *later = _CUT.split(text)
        return first, later

    def _run(self, texts: list[str], value: Callable, ids: Callable, join: Callable) -> list:
        if self.family == "whole":
            return [value(ids(e)) for e in self._encode(texts)]
        if self._made is None:
            tokenize = self.tokenizer.model.tokenize

            def make(w: str):
                """The model merges a single piece directly, without the offsets and normal forms that a
                whole encoding also makes."""
                spelled = w if w.isascii() and w.isalnum() else w.encode().decode("latin-1").translate(_BYTES)
                return value([t.id for t in tokenize(spelled)])

            self._made = _Pieces(make, self.words)
        known, kept = self._made.__getitem__, self._kept
        if len(kept) > self.words:
            kept.clear()
        rows: list[list] = []
        waiting: list[tuple[list, int, str, list[str]]] = []
        for text in texts:
            rows.append([])
            for seg in self._segments(text):
                pieces = self._plain(seg)
                if pieces is None:
                    waiting.append((rows[-1], len(rows[-1]), *self._parts(seg)))
                    rows[-1].append(None)
                else:
                    rows[-1].append(join(map(known, pieces)))
        if waiting:
            new = list({w for _, _, first, later in waiting for w in (first, *later) if w not in kept})
            kept.update((w, value(ids(e))) for w, e in zip(new, self._encode(new)))
            for row, i, first, later in waiting:
                row[i] = join(map(kept.__getitem__, (first, *later)))
        return [r[0] if len(r) == 1 else join(r) for r in rows]

    def ids(self, texts: list[str]) -> list[bytes]:
        code = self.code
        return self._run(texts, lambda ids: array(code, ids).tobytes(), lambda e: e.ids, b"".join)

    def counts(self, texts: list[str]) -> list[int]:
        return self._run(texts, len, lambda e: e, sum)


_KEPT: dict[tuple, WordEncoder] = {}


def encoder(path: str, kind: str, width: int = 4) -> WordEncoder:
    """One encoder for each tokenizer and use (``ids`` or ``count``: their caches differ) in a
    Python worker; workers are used again by later tasks, and so are the caches."""
    key = (path, kind, width)
    if key not in _KEPT:
        _KEPT[key] = WordEncoder(path, width)
    return _KEPT[key]
