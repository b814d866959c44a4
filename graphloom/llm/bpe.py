"""Byte-pair merges from a tokenizer file: a streaming transducer with a computed lookahead, and the way back to text."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator

from .pieces import PieceSplitter, byte_alphabet, slices


class MergeTable:
    """Ranks of the merge list, its vocabulary and its sufficient lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        vocab = self.vocab
        self.rank = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.alphabet = byte_alphabet()
        self.first = [vocab[c] for c in self.alphabet]
        self.last = [vocab[c + self.end] for c in self.alphabet]
        self.lookahead = self._lookahead(merges)

    def _width(self, token: str) -> int:
        return len(token) - (len(self.end) if self.end and token.endswith(self.end) and token != self.end else 0)

    def _lookahead(self, merges: list[tuple[str, str]]) -> int:
        """Bytes behind a token's end that can decide whether the token stands.

        A token can only be taken away by a merge with what follows it.  Walking the list by rank, ``steal[t]`` is
        the farthest byte behind t that merges so far can depend on, and ``form[t]`` the farthest byte behind t that
        its forming depends on: t = a+b forms if b forms and no earlier merge takes b away.  Ranks only fall along a
        chain of such dependences, so one pass over the list gives the bound.
        """
        form: dict[str, int] = {}
        steal: dict[str, int] = {}
        for a, b in merges:
            behind = max(form.get(b, 0), steal.get(b, 0))
            form[a + b] = max(form.get(a + b, 0), behind)
            steal[a] = max(steal.get(a, 0), self._width(b) + behind)
        return max(steal.values(), default=0)

    def merge(self, ids: list[int]) -> list[int]:
        """Lowest rank first, leftmost first among equals, until no pair is in the list."""
        rank, none = self.rank.get, 1 << 30
        ranks = [rank(p, none) for p in zip(ids, ids[1:])]
        while ranks and (m := min(ranks)) < none:
            i = ranks.index(m)
            ids[i] = self.made[m]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
        return ids

    def stream(self, symbols: Iterable[int], widths: list[int], block: int = 64) -> Iterator[int]:
        """Tokens of a symbol stream, each given out once it is stable.

        Holds at most ``block`` + lookahead symbols.  A token that ends at least ``lookahead`` bytes before the end
        of what is held can't change any more; merges never cross its border, so what follows is encoded on its own.
        """
        held: list[int] = []
        size = block + self.lookahead
        for s in symbols:
            held.append(s)
            if len(held) >= size:
                done, at = 0, 0
                for t in self.merge(list(held)):
                    at += widths[t]
                    if at > len(held) - self.lookahead:
                        break
                    yield t
                    done = at
                held = held[done:]
        yield from self.merge(held)


class Transducer:
    """Text to ids, piece by piece in constant memory beyond the text."""

    def __init__(self, path: str, block: int = 64):
        self.table = t = MergeTable(path)
        self.splitter = PieceSplitter(path)
        self.block = block
        names = {i: s for s, i in t.vocab.items()}
        names |= {i: s for s, i in self.splitter.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.widths = [t._width(n) for n in self.names]
        self._back = {c: b for b, c in enumerate(t.alphabet)}

    def stream_piece(self, piece: str) -> Iterator[int]:
        """Ids of a piece, each as soon as it is stable."""
        if piece in self.splitter.special:
            yield self.splitter.special[piece]
            return
        raw = piece.encode("utf-8", "surrogatepass")
        first, last, n = self.table.first, self.table.last, len(raw) - 1
        yield from self.table.stream((last[b] if i == n else first[b] for i, b in enumerate(raw)), self.widths, self.block)

    def encode_piece(self, piece: str) -> list[int]:
        return list(self.stream_piece(piece))

    def stream(self, text: str) -> Iterator[int]:
        """Ids of a text, each as soon as it is stable."""
        for part in slices(text):
            for p in self.splitter.pieces(part):
                yield from self.stream_piece(p)

    def encode(self, text: str) -> list[int]:
        return list(self.stream(text))


Utf8Machine = codecs.getincrementaldecoder("utf-8")


class Decoder:
    """Incremental ids-to-text machine.

    The file names no decoder, so a token's text is its vocabulary string and tokens are joined by one space.  The
    machine keeps one bit of state (whether anything came before) and an incremental UTF-8 decoder, so ids and the
    bytes of their strings can be fed in any slices.
    """

    def __init__(self, names: list[str]):
        self.raw = [n.encode("utf-8") for n in names]
        self.reset()

    def reset(self) -> None:
        self.machine, self.begun = Utf8Machine("replace"), False

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        data = b" ".join([self.raw[i] for i in ids])
        if self.begun:
            data = b" " + data
        self.begun = True
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)
