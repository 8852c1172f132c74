"""Token ids by the tokenizers library, with a cache of chunk encodings per worker.

A byte-level tokenizer never joins text across the space in front of a
character other than white space, so a text is cut there and every chunk is
encoded once per worker process.  Chunks are looked up as whole texts are, and
ids are gathered with numpy.  A text that holds an added token of the file
literally, such as ``<|endoftext|>``, goes to the library as a whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from pagelake.llm.common import process_cache

_cut = re.compile(r" (?=\S)")
# A place: the first id in the store, shifted, and the number of ids.
_SHIFT = 31
_LENGTH = (1 << _SHIFT) - 1
# The letter that stands for a space in a byte-level vocabulary.
_SPACE = "\u0120"
# The same for a line break.
_LINE = "\u010a"
# Marks that often stand behind a word; none is a letter, a digit, white space or an apostrophe.
_MARKS = ".,;:!?*$%&#|"
# Chunks kept per worker process (about 0.16 KB each); beyond this the cache starts anew.
CACHED_CHUNKS = 900_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in same}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(same)))
    return letters


class ChunkEncoder:
    """Encodes texts with the tokenizer in a file, as its ``encode`` does without adding special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.clear()

    def clear(self) -> None:
        # places of chunks after a space, and of first chunks of a text, which have none
        self.place: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.pieces: dict[str, list[int]] = {}
        self.ids = array("I")

    def _piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, spelled in byte letters."""
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces[piece] = [t.id for t in self.tokenize(piece)]
        return ids

    def _store(self, known: dict[str, int], key: str, ids: list[int]) -> int:
        at = known[key] = len(self.ids) << _SHIFT | len(ids)
        self.ids.extend(ids)
        return at

    def _word(self, word: str, lead: str) -> list[int]:
        """A run of letters is one pre-token, with the space in front of it if there is one: no need to split it."""
        raw = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenize(lead + raw)]

    def _lettered(self, known: dict[str, int], chunk: str, lead: str) -> list[int] | None:
        """Ids of letters with marks behind them, which are one more pre-token; None for any other chunk."""
        word = chunk.rstrip(_MARKS)
        if not word.isalpha():
            return None
        at = known.get(word)
        if at is None:
            ids = self._word(word, lead)
        else:
            begin = at >> _SHIFT
            ids = self.ids[begin:begin + (at & _LENGTH)].tolist()
        return ids + self._piece(chunk[len(word):]) if len(word) < len(chunk) else ids

    def _learn(self, chunk: str) -> int:
        """Learn a chunk that follows a space."""
        if chunk.isalpha():
            return self._store(self.place, chunk, self._word(chunk, _SPACE))
        head, line, tail = chunk.partition("\n")
        ids = self._lettered(self.place, head, _SPACE)
        if ids is not None and line:
            # a line break between letters or marks is a pre-token by itself
            rest = self._lettered(self.first, tail, "")
            ids = None if rest is None else ids + self._piece(_LINE) + rest
        return self._store(self.place, chunk, self._split(" " + chunk) if ids is None else ids)

    def _split(self, text: str) -> list[int]:
        return [i for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text) for i in self._piece(piece)]

    def _gather(self, where: list[int]) -> np.ndarray:
        """Ids at all places, one after the other."""
        at = np.array(where, "int64")
        lengths = at & _LENGTH
        ends = lengths.cumsum()
        # the view must go before the store can grow again; taking makes a copy
        return np.frombuffer(self.ids, "uint32")[np.repeat((at >> _SHIFT) - ends + lengths, lengths) + np.arange(ends[-1])]

    def encode(self, text: str) -> np.ndarray:
        """Ids of one whole text as unsigned 32-bit integers."""
        if not text:
            return np.empty(0, "uint32")
        for token in self.added:
            if token in text:
                return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "uint32")
        if len(self.place) + len(self.first) + 2 * len(self.pieces) > CACHED_CHUNKS:
            self.clear()
        chunks = text.split(" ")
        known = self.place
        where = list(map(known.get, chunks))
        at = self.first.get(chunks[0])
        where[0] = self._store(self.first, chunks[0], self._split(chunks[0])) if at is None else at
        if None in where:
            for i in [i for i, at in enumerate(where) if at is None]:
                chunk = chunks[i]
                at = known.get(chunk)
                if at is None:
                    if not chunk or chunk[0].isspace():
                        return self._encode_spaced(text)
                    at = self._learn(chunk)
                where[i] = at
        return self._gather(where)

    def _encode_spaced(self, text: str) -> np.ndarray:
        """As ``encode``, for texts with a space before other white space."""
        begins = [0, *(m.start() for m in _cut.finditer(text)), len(text)]
        where = []
        for a, b in zip(begins, begins[1:], strict=False):
            if a == b:
                continue
            if a or text[0] == " " and begins[1] == 0:
                at = self.place.get(text[a + 1:b])
                where.append(self._learn(text[a + 1:b]) if at is None else at)
            else:
                at = self.first.get(text[:b])
                where.append(self._store(self.first, text[:b], self._split(text[:b])) if at is None else at)
        return self._gather(where)


def encoder(path: str) -> ChunkEncoder:
    """The worker process's encoder for the tokenizer in ``path``."""
    return process_cache(f"encoder:{path}", lambda: ChunkEncoder(path))
