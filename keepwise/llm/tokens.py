"""Token ids of whole texts with a public tokenizer file.

The tokenizer drops white space and never joins across it, so a text's ids are
the ids of its space-separated chunks in a row. Each Python worker keeps a
bounded memo chunk -> ids (as little-endian unsigned 32-bit bytes), which turns
most of the work into dictionary look-ups. A chunk not in the memo is taken apart
where the tokenizer's own pre-tokenizer always cuts (a letter before closing
punctuation); a word of Latin-1 letters goes to its merge model directly, anything
else to the whole tokenizer. Tests hold the result against the tokenizer run on
whole texts.
"""

from __future__ import annotations

import array
import functools
import re

END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Two generations of about this many chunks are remembered; longer chunks never.
MEMO_CHUNKS, MEMO_LENGTH = 150_000, 48
_MARKS = b".,|!#%$*&;:?"
_LATIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pack(ids: list[int]) -> bytes:
    return array.array("I", ids).tobytes()


class ChunkIds(dict):
    """chunk (UTF-8 bytes) -> its ids as <u4 bytes; what is not there is looked up
    in the older generation or encoded."""

    def __init__(self, tools: "Tokens", older: dict[bytes, bytes]):
        self.tools, self.older = tools, older

    def __missing__(self, chunk: bytes) -> bytes:
        out = self.older.get(chunk)
        if out is None:
            out = self._encode(chunk)
        if len(chunk) <= MEMO_LENGTH:
            self[chunk] = out
        return out

    def _encode(self, chunk: bytes) -> bytes:
        if chunk.isalpha():   # ASCII letters only
            return _pack([t.id for t in self.tools.model.tokenize(chunk.decode().lower())])
        if chunk[:-1].isalpha() and chunk[-1] in _MARKS:     # the commonest of the next kind
            return self[chunk[:-1]] + self[chunk[-1:]]
        text = chunk.decode("utf-8", "replace")
        if _LATIN_WORD.fullmatch(text):
            return _pack([t.id for t in self.tools.model.tokenize(text.lower().translate(self.tools.spelled))])
        if b"<|" not in chunk:
            core = chunk.rstrip(_MARKS)
            if core and len(core) < len(chunk) and _LATIN_WORD.fullmatch(core[-2:].decode("utf-8", "ignore")):
                return self[core] + self[chunk[len(core):]]
        return _pack(self.tools.tokenizer.encode(text, add_special_tokens=False).ids)


class Tokens:
    """The tokenizer of a file and its memo: a young generation and the one before it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # how the byte-level step spells each letter: it is the same character by character
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [c for c in map(chr, range(256)) if _LATIN_WORD.fullmatch(c)]
        self.spelled = {ord(c): spell.pre_tokenize_str(c)[0][0] for c in letters}
        self.young = ChunkIds(self, {})

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text (null: none) as <u4 bytes."""
        if len(self.young) >= MEMO_CHUNKS:
            previous, self.young.older = self.young, {}
            self.young = ChunkIds(self, previous)
        raw = (text or "").encode("utf-8", "replace")
        if b"<|" not in raw:      # the tokenizer lower-cases everything but its special tokens: one entry for all cases
            raw = raw.lower()
        return b"".join(map(self.young.__getitem__, raw.split()))


@functools.lru_cache(maxsize=1)
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


def forget() -> None:
    """Let go of the tokenizer and its memo: a worker lives on, and stages without tokens need its memory."""
    tokens_of.cache_clear()


def text_ids(text: str | None, tokens: Tokens, end_id: int = END_ID) -> bytes:
    """Ids of a whole text and the end id, as <u4 bytes."""
    return tokens.encode(text) + end_id.to_bytes(4, "little")
