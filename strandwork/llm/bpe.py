"""Token ids of whole texts by a public tokenizer file, running the merges once for each distinct pre-token a worker sees.

Both supported files cut text into pre-tokens before any merge. Texts of plain characters are cut by
the file's own pattern; other texts into space-led chunks, at places where no pre-token can cross.
Pre-tokens and chunks repeat; their ids are kept in a bounded table.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from . import common

#: Pre-tokens kept in a worker before the table starts anew.
KEPT = 800_000
#: Characters of the longest chunk that is kept.
LONGEST = 200
#: Characters whose classes are the same in every Unicode version and library, and which lower-case one by one.
PLAIN = re.compile(r"[\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ]*")
#: The split patterns of the two files, for plain characters.
_L, _N = "a-zA-ZªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
LETTERS, NUMBERS, SIGNS = f"[{_L}]+", f"[{_N}]", rf"[^\s{_L}{_N}]+"
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
SPLIT_LOWER = re.compile(f"{LETTERS}|{NUMBERS}|{SHORT}|{SIGNS}")
SPLIT_BYTES = re.compile(rf" ?{LETTERS}|{SHORT}| ?{NUMBERS}+| ?{SIGNS}|\s+(?!\S)|\s+")
#: Characters that not every library takes for white space.
ODD_SPACES = "\x1c\x1d\x1e\x1f\x85᠎"
#: A space inside a run of white space, where a cut could change the pre-tokens.
INNER_SPACE = re.compile(r"[\s᠎] [\s᠎]")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


BYTE_LETTERS = byte_letters()


def letters(part: str) -> str:
    """A pre-token as the vocabulary spells it: a letter for each of its UTF-8 bytes."""
    if part.isascii() and part.isprintable():
        return part.replace(" ", BYTE_LETTERS[32])
    return part.encode().decode("latin-1").translate(BYTE_LETTERS)


class Whole(str):
    """A text for the library as a whole, as an added token stands in it."""


class Encoder(dict):
    """A pre-token's code by the pre-token; ``flat[at[code] : at[code + 1]]`` are its ids.

    With ``added``, the file's added tokens that stand in a text get their own ids, as in the library's
    plain call; else they are text like any other.
    """

    def __init__(self, path: str, added: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added = tuple(x.content for x in self.tokenizer.get_added_tokens_decoder().values()) if added else ()
        self.lowers = self.tokenizer.normalizer is not None
        self.split = (SPLIT_LOWER if self.lowers else SPLIT_BYTES).findall
        model = self.tokenizer.model
        model._resize_cache(0)  # the table here is the cache; the library's own would only take each new pre-token once
        self.merge = model.tokenize
        self.start_anew()

    def start_anew(self) -> None:
        self.clear()
        self.flat, self.at = array("I"), array("q", [0])

    def __missing__(self, chunk: str) -> int:
        if type(chunk) is str and PLAIN.fullmatch(chunk):
            for part in self.split(chunk.lower() if self.lowers else chunk):
                self.flat.extend([x.id for x in self.merge(letters(part))])
        else:
            self.flat.extend(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        self.at.append(len(self.flat))
        code = len(self.at) - 2
        if len(chunk) <= LONGEST:
            self[chunk] = code
        return code

    def marked(self, text: str) -> bool:
        return any(x in text for x in self.added)

    def cut(self, text: str) -> list[str]:
        """Pieces of the text, each of which may be encoded alone."""
        if self.marked(text):
            return [Whole(text)]
        if PLAIN.fullmatch(text):
            return self.split(text.lower() if self.lowers else text)
        if self.lowers:
            return [text] if any(x in text for x in ODD_SPACES) else text.split()
        if INNER_SPACE.search(text):
            return [text]
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)]

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of the texts, ``end`` after each, and where each text begins, with the total at last."""
        if len(self.at) > KEPT:
            self.start_anew()
        codes = [np.fromiter(map(self.__getitem__, own), np.int64, len(own)) for own in map(self.cut, texts)]
        flat, at = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.zeros(0, np.uint32), np.frombuffer(self.at, np.int64)
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        begin = at[code]
        size = at[code + 1] - begin
        done = np.concatenate([[0], np.cumsum(size)])
        starts = done[np.cumsum([0, *map(len, codes)])] + np.arange(len(codes) + 1)
        out = np.full(starts[-1], end, np.uint32)
        shift = np.repeat(np.arange(len(codes)), np.diff(starts) - 1)
        source = np.arange(done[-1])
        out[source + shift] = flat[source + np.repeat(begin - done[:-1], size)]
        return out, starts


def encoder(path: str, added: bool = False) -> Encoder:
    """The worker's encoder."""
    return common.worker_table(("bpe", path, added), lambda: Encoder(path, added))
