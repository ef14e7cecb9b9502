"""Byte-level BPE of a public tokenizer file, the ids of whole texts by batches."""

from __future__ import annotations

import functools
import json

import numpy as np

SPECIAL = "<|endoftext|>"
#: The pre-token rule of byte-level vocabularies of this kind, without and with the
#: look-ahead that sets the last character of longer white space apart.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
AHEAD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII_SPACE = bytes(0x20 if b in b"\t\n\x0b\x0c\r " else b for b in range(256))
_WIDE_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 bytes stand for themselves, the others follow from 256."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def single_spaced(text: str) -> bool:
    """True if no two white space characters stand together; then the look-ahead changes nothing. May be False without need."""
    data = text.encode()
    return b"  " not in data.translate(_ASCII_SPACE) and (text.isascii() or not any(w in data for w in _WIDE_SPACE))


class Bpe:
    """Ids as tokenizers gives them for the same file with add_special_tokens=False; tests hold it against that library.

    Texts without double white space take a rule that needs no look-ahead and runs a third faster;
    a text that holds the special token's string goes through the tokenizers library.
    """

    def __init__(self, json_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(json_path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        back = _byte_of_char()
        ranks = {bytes(map(back.__getitem__, s)): i for s, i in vocab.items() if s != SPECIAL}
        self._plain, self._ahead = (tiktoken.Encoding("bpe", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (PLAIN, AHEAD))
        self._library = Tokenizer.from_file(json_path)
        self.size = self._library.get_vocab_size()

    def ids(self, text: str) -> list[int]:
        if SPECIAL in text:
            return self._library.encode(text, add_special_tokens=False).ids
        return (self._plain if single_spaced(text) else self._ahead)(text)

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end as uint32, offsets: len(texts)+1). Null counts as empty; end: an id put after each text."""
        tail = [] if end is None else [end]
        each = [np.array(self.ids(t or "") + tail, np.uint32) for t in texts]
        return np.concatenate([np.zeros(0, np.uint32), *each]), np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64)


@functools.cache
def tokenizer(json_path: str) -> Bpe:
    """One for each Python worker and file."""
    return Bpe(json_path)
