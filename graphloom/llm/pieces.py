"""Pieces (pre-tokens) of a word-level BPE tokenizer file, and memos of what they encode to.

The file's normaliser is NFC, white space to one space, lower case; its pattern keeps runs of letters, single
numbers, runs of other signs and a few clitics; white space only separates.  Hence the encoding of a text is the
concatenation of the encodings of its white-space separated chunks, and a chunk's encoding can be remembered.
"""

from __future__ import annotations

import json
import unicodedata

import regex

#: str.split() parts text at these four control characters, the tokenizer's pattern does not.
SEPARATOR_CONTROLS = "\x1c\x1d\x1e\x1f"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary, derived by its rule:
    printable Latin-1 bytes stand for themselves, the others take code points from 256 on in order."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class PieceSplitter:
    """Splits text into the tokenizer's pieces; special strings come out as their own pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        #: Beyond these code points the Unicode versions of pattern engines differ, so the file's own parts split there.
        self.plain = regex.compile("[\\x00-\\u024f]*")
        self.path, self.own, self.back = path, None, {c: b for b, c in enumerate(byte_alphabet())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))

    def normalize(self, text: str) -> str:
        if not text.isascii():
            # lower case goes character by character: no final-sigma rule
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _run(self, text: str) -> list[str]:
        core = text.rstrip(",.")
        word = self.normalize(core)  # tested after it: lower case can turn a letter into one and a mark
        if word.isalpha() and (text.isascii() or max(text) < "\u0250"):  # a word and what ends it, by far most chunks
            return [word, text[len(core) :]] if len(core) < len(text) else [word]
        if self.plain.fullmatch(text):
            return self.pattern.findall(self.normalize(text))
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path)
        split = self.own.pre_tokenizer.pre_tokenize_str(self.own.normalizer.normalize_str(text))
        return [bytes(map(self.back.__getitem__, p)).decode("utf-8") for p, _ in split]

    def pieces(self, text: str) -> list[str]:
        if "<|" not in text:
            return self._run(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += self._run(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self._run(text[at:])


def chunks(text: str) -> list[str]:
    """White-space separated chunks whose encodings concatenate to the text's."""
    if any(c in text for c in SEPARATOR_CONTROLS):
        return regex.findall(r"[^\t-\r \x85\p{Z}]+", text)
    return text.split()


_SPACE = regex.compile(r"[\t-\r \x85\p{Z}]")


def slices(text: str, size: int = 1 << 16):
    """Parts of a text of about ``size`` characters, cut at white space: their encodings concatenate to the text's."""
    at = 0
    while len(text) - at > size and (m := _SPACE.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class Memo(dict):
    """chunk -> value.  Holds at most ``limit`` entries: beyond it the older half of the entries goes.

    It only saves work; a forgotten chunk is computed again, so results never depend on the limit.
    """

    def __init__(self, compute, limit: int = 300_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, chunk):
        value = self.compute(chunk)
        if len(chunk) <= self.longest:
            self[chunk] = value
        return value

    def trim(self) -> None:
        """Between batches."""
        if len(self) > self.limit:
            for key in list(self)[: len(self) // 2]:
                del self[key]
