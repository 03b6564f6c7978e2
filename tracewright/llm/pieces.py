"""Token ids of whole texts, with each distinct piece of a text encoded once per worker."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable

import numpy as np

#: Entries kept per worker, some 200 bytes each. Frequent pieces come early; those that find the table full are encoded
#: once per block of texts.
TABLE_LIMIT = 300_000

CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _classes() -> tuple[str, str, str]:
    """Letters, digits and others among the plain characters: ASCII without controls, Latin-1 and Latin Extended-A.

    They are single characters in every normal form, and each lower-cases to one
    character; U+0130, which doesn't, is left out.
    """
    chars = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x180)) if c != 0x130]
    kind = lambda c: unicodedata.category(c)[0]
    return tuple("".join(re.escape(c) for c in chars if test(kind(c))) for test in (lambda k: k == "L", lambda k: k == "N", lambda k: k not in "LN"))


LETTERS, DIGITS, OTHERS = _classes()
NOT_PLAIN = re.compile(f"[^ \\t\\n\\r{LETTERS}{DIGITS}{OTHERS}]")
SPACED = f"{CONTRACTIONS}| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[{OTHERS}]+|[ \\t\\n\\r]+(?![^ \\t\\n\\r])|[ \\t\\n\\r]+"
WORDS = f"{CONTRACTIONS}|[{LETTERS}]+|[{DIGITS}]|[{OTHERS}]+"


class PieceEncoder:
    """encode(texts) gives the bytes of the same ids as the library gives for each whole text.

    A tokenizer first splits a text by a pattern and then encodes each piece by
    itself. Where the text has only plain characters and no special token, and the
    tokenizer is of one of the two known kinds, the split is done here and a piece's
    ids come from a table. Every other text goes to the library as a whole.
    """

    def __init__(self, path: str, limit: int = TABLE_LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"])) if spec["added_tokens"] else None
        self.lower, self.pattern, self.between, self.alone = _kind(spec)
        self.mark = self._ids([self.between.strip(" ")])[0] if self.pattern else b""
        self.table: dict[str, bytes] = {}
        self.limit = limit

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Joined pieces cost the library far less than as many texts of one piece."""
        alone = [p for p in new if self.alone.fullmatch(p)]
        learnt = dict(zip(alone, self._ids(alone)))
        rest, mark, wide = [p for p in new if not self.alone.fullmatch(p)], np.frombuffer(self.mark, self.dtype)[0], self.dtype.itemsize
        for i in range(0, len(rest), 1000):
            part = rest[i : i + 1000]
            buffer = self._ids([self.between.join(part)])[0]
            ends = np.flatnonzero(np.frombuffer(buffer, self.dtype) == mark)
            if len(ends) != len(part) - 1:
                raise ValueError("a piece holds the separator's token")
            starts = [0, *((ends + 1) * wide).tolist()]
            stops = [*(ends * wide).tolist(), len(buffer)]
            learnt.update(zip(part, [buffer[a:b] for a, b in zip(starts, stops)]))
        return learnt

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Of distinct words: pieces of plain texts together, any other string by itself."""
        piece = self.pattern.fullmatch if self.pattern else lambda _: None
        known = self._learn([w for w in words if piece(w) and (not self.lower or w == w.lower())])
        rest = [w for w in words if w not in known]
        known.update(zip(rest, self._ids(rest)))
        return [known[w] for w in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.pattern is None:
            return self._ids(texts)
        split: list[list[str] | None] = []
        wanted: set[str] = set()
        for text in texts:
            plain = NOT_PLAIN.search(text) is None and not (self.special and self.special.search(text))
            pieces = self.pattern.findall(text.lower() if self.lower else text) if plain else None
            split.append(pieces)
            if plain:
                wanted.update(pieces)
        table, learnt = self.table, self._learn([p for p in wanted if p not in self.table])
        if len(table) + len(learnt) <= self.limit:
            table.update(learnt)
        else:
            table = table | learnt
        get = table.__getitem__
        return [self._ids([text])[0] if pieces is None else b"".join(map(get, pieces)) for text, pieces in zip(texts, split)]


def _kind(spec: dict) -> tuple[bool, re.Pattern | None, str, re.Pattern | None]:
    """Whether the text is lower-cased, the pattern of its pieces, what keeps pieces apart in a joined text and what
    must not be joined; no pattern for unknown kinds.

    The separator is a piece of its own wherever it stands, one token that no other joined piece has.
    """
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if spec.get("post_processor") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return False, re.compile(SPACED), "\n", re.compile("[ \\t\\n\\r]+")
    steps = [p.get("type") for p in pre.get("pretokenizers", [])]
    if steps == ["Split", "ByteLevel"]:
        split, level = pre["pretokenizers"]
        rule = split["pattern"].get("Regex", "")
        norms = [n.get("type") for n in norm.get("normalizers", [])]
        known = rule == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and split["behavior"] == "Removed" and split["invert"]
        if known and norms == ["NFC", "Replace", "Lowercase"] and not level["use_regex"] and not level["add_prefix_space"]:
            return True, re.compile(WORDS), " 0 ", re.compile(f"[{DIGITS}]")
    return False, None, "", None


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One per worker process and file; its table serves all the tasks of the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def in_blocks(texts: Iterable[str], max_chars: int = 1 << 22) -> Iterable[list[str]]:
    """Consecutive texts of about `max_chars` together; a longer one is alone."""
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text)
        if size >= max_chars:
            yield block
            block, size = [], 0
    if block:
        yield block
