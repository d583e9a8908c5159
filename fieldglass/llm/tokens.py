"""Tokenizing whole documents inside tasks with a public vocabulary file.

Where a vocabulary drops white space and lower-cases, the ids of a text are those of its words in turn. So words are numbered
in Arrow, and the library encodes each distinct one once as long as the worker keeps it. What a worker keeps
is bounded by bytes (``KEPT_BYTES``, twice: the words in use and those used before), looked at after each slice of texts. Any other vocabulary gets whole texts.

Nulls and edges: a null text counts as empty; an empty text has the end id only; a text of any length is one slice of its own
at most; no texts give nothing; special tokens in a text are read as the library reads them.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handed to the tokenizer in slices of about this many characters, so encodings stay small; word by word, slices can be longer.
SLICE_CHARS, WORD_SLICE_CHARS = 1_000_000, 2_000_000
#: Numbered words are turned into ids so many at a time.
WORDS_AT_ONCE = 1 << 17
#: Pieces that are encoded in one text.
PIECES_AT_ONCE = 100
#: Bytes of words and ids that a worker keeps, and what an entry takes besides.
KEPT_BYTES, ENTRY_BYTES = 40_000_000, 150

_loaded: dict[str, object] = {}


def default_tokenizer() -> str:
    """Path of the default vocabulary file; asked for where it is used, so each machine finds its own."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenizer(path: str | None):
    """The tokenizer of a file, loaded once in each Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    path = path or default_tokenizer()
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def encode_all(texts: list[str | None], path: str | None, end_id: int) -> Iterator[np.ndarray]:
    """Token ids of each text with ``end_id`` after them; a null text counts as empty."""
    model, lot, chars = tokenizer(path), [], 0
    encode, most = (_encode_words, WORD_SLICE_CHARS) if splits_at_spaces(model) else (_encode, SLICE_CHARS)
    for text in texts:
        lot.append(text or "")
        chars += len(lot[-1])
        if chars >= most:
            yield from encode(model, lot, end_id)
            lot, chars = [], 0
    yield from encode(model, lot, end_id)


def _encode(model, lot: list[str], end_id: int) -> Iterator[np.ndarray]:
    for coded in model.encode_batch_fast(lot, add_special_tokens=False) if lot else ():
        ids = coded.ids
        ids.append(end_id)
        yield np.array(ids, dtype=np.uint32)


#: Fixed value: the split of a vocabulary that drops white space and never joins a letter or digit with punctuation.
SPACELESS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts with combining marks (which compose by case) or with what may be a special token keep their case.
CASED = r"[\x{0300}-\x{036F}]|<\|"
#: Letters beyond ASCII that are one letter in lower case too, so that they never join with what stands beside them.
LETTERS = "".join(c for c in map(chr, range(0x80, 0x250)) if c.isalpha() and len(c.lower()) == 1 and c.lower().isalpha())
#: Marks that never belong to a piece with letters; an apostrophe may.
MARKS = r"!-&(-/:-@\[-`{-~"
PIECE = re.compile(f"[a-z{LETTERS}]+|[0-9]|[{MARKS}]+")
#: Borders between a letter or digit and a mark.
BORDERS = (f"([a-z0-9{LETTERS}])([{MARKS}]+)", f"([{MARKS}])([a-z0-9{LETTERS}])")
_spaceless: dict[int, bool] = {}


def splits_at_spaces(model) -> bool:
    """Whether the ids of a text are the ids of its words in turn: lower case, no token over white space."""
    if id(model) not in _spaceless:
        parts = json.loads(model.to_str())
        steps = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        lower = any(x.get("type") == "Lowercase" for x in (parts.get("normalizer") or {}).get("normalizers") or [])
        drops = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and steps[0].get("pattern") == {"Regex": SPACELESS}
        _spaceless[id(model)] = bool(lower and drops)
    return _spaceless[id(model)]


class Words:
    """The ids of words, encoded when first asked for; the words used least recently go first."""

    def __init__(self, model):
        self.model, self.now, self.before, self.size = model, {}, {}, 0
        suffix, ids = json.loads(model.to_str())["model"].get("end_of_word_suffix") or "", model.get_vocab()
        #: for each id, whether its token closes a piece
        self.ends = np.zeros(max(ids.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for token, i in ids.items() if token.endswith(suffix)]] = True

    def of(self, names: list[str]) -> list[bytes]:
        """The ids (32 bits each) of distinct words."""
        found = list(map(self.now.get, names))
        lost = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in lost:
            found[i] = self.before.get(names[i])
            if found[i] is None:
                new.append(i)
        pieces = [i for i in new if PIECE.fullmatch(names[i])]
        for at in range(0, len(pieces), PIECES_AT_ONCE):
            lot = pieces[at : at + PIECES_AT_ONCE]
            for i, ids in zip(lot, self._together([names[i] for i in lot])):
                found[i] = ids
        alone = [i for i in new if found[i] is None]
        for i, ids in zip(alone, self._apart([names[i] for i in alone])):
            found[i] = ids
        self.now.update((names[i], found[i]) for i in lost)
        self.size += sum(ENTRY_BYTES + len(names[i]) + len(found[i]) for i in lost)
        if self.size > KEPT_BYTES:
            self.now, self.before, self.size = {}, self.now, 0
        return found

    def _together(self, lot: list[str]) -> list[bytes]:
        """Many pieces in one text with spaces between, told apart by the tokens that close them; a lot that does not come apart is encoded one by one."""
        ids = np.array(self.model.encode_batch_fast([" ".join(lot)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        borders = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(borders) != len(lot) or borders[-1] != 4 * len(ids):
            return self._apart(lot)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *borders], borders)]

    def _apart(self, lot: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype=np.uint32).tobytes() for x in (self.model.encode_batch_fast(lot, add_special_tokens=False) if lot else ())]


_words: dict[int, Words] = {}


def _split(texts: pa.Array) -> pa.Array:
    """The words that are looked up: lower case, marks apart from letters and digits."""
    small = pc.ascii_lower(texts)
    for border in BORDERS:
        small = pc.replace_substring_regex(small, border, r"\1 \2")
    return pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts, CASED), texts, small))


def _encode_words(model, lot: list[str], end_id: int) -> Iterator[np.ndarray]:
    """Texts are looked up in one pass over numbered words."""
    if not lot:
        return
    if id(model) not in _words:
        _words[id(model)] = Words(model)
    split = _split(pa.array(lot, pa.large_string()))
    numbered = pc.dictionary_encode(split.values)
    table = _words[id(model)].of(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
    flat, size = np.frombuffer(b"".join(table), dtype=np.uint32), np.fromiter(map(len, table), dtype=np.int64, count=len(table)) // 4
    first, word, borders = np.cumsum(size) - size, numbered.indices.to_numpy(), split.offsets.to_numpy()
    end = np.array([end_id], dtype=np.uint32)
    for a, b in zip(borders[:-1], borders[1:]):
        yield np.concatenate([*(_ids(flat, first, size, word[at : min(b, at + WORDS_AT_ONCE)]) for at in range(a, b, WORDS_AT_ONCE)), end])


def _ids(flat: np.ndarray, first: np.ndarray, size: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The ids of numbered words in turn; those of word ``w`` are the ``size[w]`` from ``first[w]`` on in ``flat``."""
    n = size[word]
    ends = np.cumsum(n)
    return flat[np.repeat(first[word] - ends + n, n) + np.arange(ends[-1])]
