"""Token ids of a byte-level BPE file by the tokenizers library, with a memo of words.

Byte-level BPE cuts a text before every single space between words and around every single line
feed between lines, so the ids of a word with the space before it don't depend on what stands around
them. A word is encoded once by the library and looked up afterwards: a text is split at spaces,
`w` stands for " w", a line's first word has FIRST before it, and white space of any other kind is
found by a regular expression and has SPACE before it. A plain word (Latin letters, then
punctuation) goes to the library's BPE model as the pre-tokenizer would cut it, others through the
whole tokenizer. The strings of added tokens get those tokens' ids, as the library's default is;
`text_specials` makes ordinary text of the special ones. Files of any other kind of tokenizer, for
which the memo would be wrong, go through the library text by text.
"""

from __future__ import annotations

import itertools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FIRST, SPACE = "\x01", "\x02"
#: The pre-tokenizer's cut at white space: a word with one leading space, all but the last of a run of white space, one white space.
RUN = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Engines differ on whether these are white space.
ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]")
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,!?;:]*)")
#: Distinct words remembered by one worker; bytes of texts split at once; characters of one text given to the regular expression at once.
MEMO, CHUNK, PIECE = 400_000, 4 << 20, 1 << 20
#: Number of a key that says: the text has other white space than single spaces and line feeds between words.
BAD = 0


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 itself, the others from U+0100 on in turn."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def byte_level(spec: dict) -> bool:
    """Whether a tokenizers file is plain byte-level BPE, so that words can be encoded apart."""
    cut, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
    own = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    return bool(plain and model.get("type") == "BPE" and not any(model.get(k) for k in own) and set(byte_letters().values()) <= set(model["vocab"]))


class Memo(dict):
    """Numbers keys as they are first asked for; `new` lists those not encoded yet."""

    def __init__(self) -> None:
        self[""] = BAD
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = k = len(self)
        self.new.append(key)
        return k


class Encoder:
    """encode(texts) -> list of uint32 arrays. `path` names the tokenizer's JSON file."""

    def __init__(self, path: str, memo: int = MEMO, text_specials: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = text_specials
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t for t in spec.get("added_tokens") or [] if not (text_specials and t["special"])]
        self.added = {t["content"]: t["id"] for t in added}
        self.memoable = byte_level(spec) and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.letters = byte_letters()
        self.model = self.tokenizer.model
        self.marks: dict[str, list[int]] = {"": []}
        self.limit = memo
        self.memo = Memo()
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _bpe(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        mapped = ("Ġ" + word[1:] if word[0] == " " else word) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(mapped)]

    def _learn(self, keys: list[str]) -> list[str]:
        """Encode new keys; returns the bad ones."""
        found: list[list[int]] = [[]] * len(keys)
        odd, bad, plain, marks, base = [], [], PLAIN.fullmatch, self.marks, len(self.memo) - len(keys)
        for k, key in enumerate(keys):
            head = key[0]
            if head == SPACE or key == "\n":
                odd.append((k, key.removeprefix(SPACE)))
                continue
            word = key[1:] if head == FIRST else key
            m = plain(word)
            if m:
                stem, mark = m.groups()
                if mark not in marks:
                    marks[mark] = self._bpe(mark)
                known = self.memo.get(FIRST + stem if head == FIRST else stem, base) if mark else base
                ids = self._bpe(stem if head == FIRST else " " + stem) if known >= base else self.flat[self.starts[known] : self.starts[known] + self.sizes[known]].tolist()
                found[k] = ids + marks[mark]
            elif not word or word[0].isspace() or word[-1].isspace() or ODD.match(word[0]) or ODD.match(word[-1]):
                bad.append(key)
            else:
                odd.append((k, word if head == FIRST else " " + word))
        if odd:
            for (k, _), e in zip(odd, self.tokenizer.encode_batch_fast([w for _, w in odd], add_special_tokens=False)):
                found[k] = e.ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        k, total = base, int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while len(self.memo) > len(self.starts):
            self.starts, self.sizes = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.sizes))
        self.flat[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(found), np.uint32, total)
        self.starts[k : k + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[k : k + len(keys)] = sizes
        self.used += total
        return bad

    def _numbers(self, keys: list[str]) -> np.ndarray:
        """Numbers of keys, BAD for bad ones; new keys are encoded."""
        new = self.memo.new
        index = np.fromiter(map(self.memo.__getitem__, keys), np.int32, len(keys))
        if new:
            for key in self._learn(new):
                index[index == self.memo[key]] = BAD
                self.memo[key] = BAD
        return index

    def _gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered keys one after another, and where each key's ids end."""
        size = self.sizes[index]
        ends = np.cumsum(size, dtype=np.int32)
        at = np.repeat(self.starts[index] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        return self.flat[at], ends

    def _forget(self, used: int) -> None:
        """Once the memo is full, drop what was new: what came first, and so the frequent words, stays."""
        if len(self.memo) > self.limit:
            for key in self.memo.new:
                del self.memo[key]
            self.used = used
        self.memo.new.clear()

    def _slowly(self, text: str) -> np.ndarray:
        """A text with other white space: words by the regular expression."""
        if FIRST in text or SPACE in text or ODD.search(text):
            return self.whole([text])[0]
        out = [np.zeros(0, np.uint32)]
        for piece in pieces(text):
            used = self.used
            index = self._numbers([SPACE + r if r.isspace() else r[1:] if r[0] == " " else FIRST + r for r in RUN.findall(piece)])
            if (index == BAD).any():
                self._forget(used)
                return self.whole([text])[0]
            out.append(self._gather(index)[0])
            self._forget(used)
        return np.concatenate(out)

    def _some(self, texts: pa.StringArray) -> list[np.ndarray]:
        lines = pc.binary_join_element_wise(FIRST, pc.replace_substring(texts, "\n", f" \n {FIRST}"), "")
        words = pc.split_pattern(lines, " ")
        upto = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        used = self.used
        index = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ids, ends = self._gather(index)
        self._forget(used)
        cuts = np.concatenate(([0], ends))[upto]
        out = np.split(ids, cuts[:-1])
        bad = set(np.searchsorted(upto, np.flatnonzero(index == BAD), "right").tolist())
        marked = pc.or_(pc.match_substring(texts, FIRST), pc.match_substring(texts, SPACE))
        bad.update(np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist())
        for k in bad:
            out[k] = self._slowly(texts[k].as_py())
        return out

    def _around(self, text: str) -> np.ndarray:
        """A text with strings of added tokens: what lies between them is encoded by itself."""
        parts = self.apart.split(text)
        between = self.encode(parts[::2])
        out = [between[0]]
        for content, ids in zip(parts[1::2], between[1:]):
            out += [np.array([self.added[content]], np.uint32), ids]
        return np.concatenate(out)

    def encode(self, texts: pa.StringArray | list[str]) -> list[np.ndarray]:
        """The ids of each text; none may be null."""
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        special = np.zeros(0, np.int64)
        if self.memoable and self.added:
            held = [pc.match_substring(column, t).to_numpy(zero_copy_only=False) for t in self.added]
            special = np.flatnonzero(np.logical_or.reduce(held)) if len(column) else special
        plain = column
        if len(special):
            mask = np.zeros(len(column), bool)
            mask[special] = True
            plain = pc.if_else(pa.array(mask), "", column)
        size = np.cumsum(pc.binary_length(plain).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0)
        out, at = [], 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")))
            part = plain.slice(at, to - at)
            out += self._some(part) if self.memoable else self.whole(part.to_pylist())
            at = to
        for k in special.tolist():
            out[k] = self._around(column[k].as_py())
        return out


def pieces(text: str, size: int = PIECE) -> list[str]:
    """Cut a long text before single spaces between words; a piece without such a place stays longer."""
    if len(text) <= size:
        return [text]
    cut = re.compile(r"(?<=\S) (?=\S)")
    found, at = [], 0
    while len(text) - at > size and (m := cut.search(text, at + size)):
        found.append(text[at : m.start()])
        at = m.start()
    return [*found, text[at:]]


_encoders: dict[tuple[str, bool], Encoder] = {}


def release() -> None:
    """Give the memos back, where a worker goes on to other work."""
    if _encoders:
        _encoders.clear()
        pa.default_memory_pool().release_unused()


def encoder(path: str, text_specials: bool = False) -> Encoder:
    """The worker's own encoder of a file, kept between batches and tasks."""
    key = (path, text_specials)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, text_specials=text_specials)
    return _encoders[key]
