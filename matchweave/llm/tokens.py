"""Encoding texts with a public tokenizer inside Spark tasks.

The vocabulary used here lower-cases, drops white space, splits a text into words, single
digits and runs of other characters, and merges inside each of those alone. So a task
keeps the ids of parts it has met and joins them. A text whose characters all lie below
U+0100 is split by the same rule as the vocabulary's, and its new parts are merged, many
at a time, by the same merge ranks with the end of a word as a byte of its own. Any other
text is split at white space only, and its stretches go to the tokenizer itself.
The result equals encoding the whole text (tests compare the two over all documents and
over random characters).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Texts taken from an Arrow batch at a time, so that no copy of a whole batch is held.
TEXTS_AT_ONCE = 256
# Parts kept by a worker before the older half is forgotten, and the longest part kept.
REMEMBERED = 160_000
LONGEST = 48
# Fixed values of the vocabulary's splitting rule, for lower-cased characters below U+0100.
LETTERS = "a-zªµºß-öø-ÿ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\t-\r \u0085 "
PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
WORD_END = "</w>"

_ENCODERS: dict[str, PartEncoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class PartEncoder:
    """Token ids as little-endian unsigned 32-bit bytes, with a bounded memory of parts."""

    def __init__(self, path: str, remembered: int = REMEMBERED, longest: int = LONGEST):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered, self.longest = remembered, longest
        self.parts = _Memory(remembered, longest)
        self.stretches = _Memory(remembered, longest)
        symbols, ranks, ends = _byte_symbols(), {}, []
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            at_end = token.endswith(WORD_END) and token != WORD_END
            body = token.removesuffix(WORD_END) if at_end else token
            if all(c in symbols for c in body):
                ranks[bytes(symbols[c] for c in body) + b"\n" * at_end] = number
                ends += [number] * at_end
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.ends_word[ends] = True
        special = set(self.tokenizer.get_added_tokens_decoder())
        ranks = {b: n for b, n in ranks.items() if n not in special}
        self.merger = tiktoken.Encoding("parts", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})

    def _merge(self, parts: list[str]) -> list[bytes]:
        """Ids of parts, each a whole part of the splitting rule."""
        if not parts:
            return []
        ids = np.array(self.merger.encode_ordinary("\n".join(parts) + "\n"), "<u4")
        starts = [0, *(4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()]
        if len(starts) != len(parts) + 1:
            raise ValueError("the vocabulary does not mark the ends of words")
        data = ids.tobytes()
        return [data[i:j] for i, j in zip(starts, starts[1:])]

    def _tokenize(self, stretches: list[str]) -> list[bytes]:
        codes = self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False)
        return [np.array(c.ids, "<u4").tobytes() for c in codes]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null text has none."""
        out: list[bytes] = [b""] * len(texts)
        # Strings that stand for special tokens are whole ids; the tokenizer itself finds them.
        narrow = [i for i, t in enumerate(texts) if t and "<|" not in t and _is_narrow(t)]
        wide = [i for i, t in enumerate(texts) if t and ("<|" in t or not _is_narrow(t))]
        for which, split, memory, make in (
            (narrow, [PART.findall(texts[i].lower()) for i in narrow], self.parts, self._merge),
            (wide, [_at_spaces(texts[i]) for i in wide], self.stretches, self._tokenize),
        ):
            known = memory.look_up(set().union(*split), make)
            for i, parts in zip(which, split):
                out[i] = b"".join(map(known.__getitem__, parts))
            memory.forget()
        return out


def _at_spaces(text: str) -> list[str]:
    """Stretches between characters that the tokenizer's own pattern takes as white space."""
    return text.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ")


def _is_narrow(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Memory:
    """Values of strings met before; the older half is forgotten when it grows too large."""

    def __init__(self, size: int, longest: int):
        self.half, self.longest = size // 2, longest
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []

    def look_up(self, wanted: set[str], make) -> dict[str, bytes]:
        """A dictionary that holds every wanted string, valid until `forget`."""
        wanted -= self.new.keys()
        missing = [key for key in wanted if key not in self.old]
        self.new.update((key, self.old[key]) for key in wanted if key in self.old)
        self.new.update(zip(missing, make(missing)))
        self.long = [key for key in missing if len(key) > self.longest]
        return self.new

    def forget(self) -> None:
        for key in self.long:
            del self.new[key]
        self.long = []
        if len(self.new) > self.half:
            self.new, self.old = {}, self.new


def encoder_of(path: str) -> PartEncoder:
    """The worker's encoder for a vocabulary file, kept for its next tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PartEncoder(path)
    return _ENCODERS[path]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
        yield batch.slice(at, TEXTS_AT_ONCE)
