"""Cutting texts into chunks that the public tokenizers of operators 11 and 12 encode independently of each other.

A cut stands before a space or line end that follows a character that isn't white space. The byte-level split never takes a
piece over such a place, and no piece of the sentence-piece vocabulary holds a space or line end behind another character
(``pieces_allow`` looks). So the ids of a text are those of its chunks in a row, and a worker encodes each kind of chunk
once: unseen chunks of a step are put together to one text, whose ids are cut at the chunks' ends by the tokens' byte lengths.

Where a byte-level file's merges are in the order of their ids, tiktoken gives the same ids from the same vocabulary, seven
times as fast; chunks of plain Latin characters go there, all others to the tokenizers library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

# Fixed value: the split of byte-level tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks whose characters are classed alike by every library.
LATIN = re.compile(r"[ \n][!-~\u00a1-\u024f]+")
PLAIN = re.compile(r"[ \n!-~\u00a1-\u024f]*")
#: Kinds of chunks that a worker keeps; it starts afresh beyond.
KEEP = 400_000
CUT = re.compile(r"(?<=\S)(?=[ \n])")


def cut(text: str) -> list[str]:
    """The chunks of a text, in a row the text; an empty text has none."""
    words = text.split()
    marks = text.count(" ") + text.count("\n")
    # Single spaces and line ends between words, and no other white space.
    if marks == len(words) - 1 and sum(map(len, words)) + marks == len(text) and "\0" not in text:
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    return CUT.split(text) if text else []


def pieces_allow(pieces: list[str], space: str = "▁") -> bool:
    return not any(space in p.lstrip(space) or "\n" in p[1:] for p in pieces)


def split_ids(ids: np.ndarray, lengths: np.ndarray, chunks: list[str]) -> list[bytes] | None:
    """The ids of each chunk, from those of all in a row, as bytes; None if tokens don't end where chunks do."""
    ends = np.cumsum(lengths[ids])
    bounds = np.cumsum(np.fromiter((len(c.encode("utf-8", "surrogatepass")) for c in chunks), np.int64, len(chunks)))
    at = np.searchsorted(ends, bounds)
    if len(ends) == 0 or at[-1] >= len(ends) or (ends[at] != bounds).any():
        return None
    raw = ids.astype("<i4").tobytes()
    cuts = (4 * (at + 1)).tolist()
    return [raw[a:b] for a, b in zip([0, *cuts], cuts)]  # noqa: B905


class ByteLevel:
    """A byte-level tokenizer: ids of texts, bytes of ids."""

    def __init__(self, path: str, special: bool):
        """``special``: whether special tokens' strings in a text stand for these tokens."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        told = json.loads(self.tokenizer.to_str())
        split = told["pre_tokenizer"] or {}
        plain = told["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        # A word beside the vocabulary must not reach over a cut, nor take white space from beside it.
        self.by_chunks = bool(plain) and all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not any(c.isspace() for c in t["content"]) for t in told["added_tokens"])
        self.bytes_of = [b""] * self.tokenizer.get_vocab_size()
        # The alphabet stands for bytes: printable ones for themselves, the others from U+0100 on, in order.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        spelled = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        assert set(spelled) == set(pre_tokenizers.ByteLevel.alphabet())
        added = {t["id"]: t["content"] for t in told["added_tokens"]}
        for piece, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = added[i].encode() if i in added else bytes(spelled[c] for c in piece)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)

        ordered = [told["model"]["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in told["model"]["merges"]]
        self.fast = None
        if self.by_chunks and all(a < b for a, b in zip(ordered, ordered[1:])):  # noqa: B905
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.bytes_of) if i not in added}
            self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.special = [t["content"] for t in told["added_tokens"] if special]

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit numbers."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<i4").tobytes()

    def latin(self, text: str) -> bytes:
        """As ``ids``, faster for plain Latin texts."""
        if self.fast and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), "<i4").tobytes()
        return self.ids(text)

    def of_chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of some different chunks."""
        made: dict[str, bytes] = {}
        if self.fast:
            # Only what begins with white space can stand behind another chunk.
            plain = [c for c in chunks if LATIN.fullmatch(c) and not any(s in c for s in self.special)]
            found = split_ids(np.array(self.fast.encode_ordinary("".join(plain)), np.int32), self.lengths, plain) if plain else []
            made = dict(zip(plain, found or (), strict=found is not None))
        return [made[c] if c in made else self.ids(c) for c in chunks]
