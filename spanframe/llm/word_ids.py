"""Ids of texts from a public tokenizer, by a memory of their words' parts."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np

from spanframe.llm.common import in_slices, mix64, worker_memory
from spanframe.llm.hash_memo import HashMemo

#: Parts that a worker remembers, and letters that one call of the tokenizer gets at most.
MEMO = 600_000
CALL = 1 << 18
#: Bytes of text that are encoded at once.
SLICE = 1 << 19
#: The pre-tokenizer pattern under which letters, digits and other signs part (fixed value).
_PARTING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
_FACTORS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file and the type of its ids."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return t, "<u2" if t.get_vocab_size() <= 1 << 16 else "<u4"


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of every code point below the surrogates; those that
    normalization may join or split, and those above, are ODD: words with them
    are encoded whole."""
    kinds, lower = np.full(0xD800, ODD, dtype=np.uint8), np.arange(0xD800, dtype=np.uint32)
    of = {"L": LETTER, "N": DIGIT, "P": SIGN, "S": SIGN}
    for c in range(0xD800):
        char = chr(c)
        low = char.lower()
        if char in " \t\n\r\x0b\x0c":
            kinds[c] = SPACE
        elif len(low) == 1 and not 0x1100 <= c < 0x1200 and unicodedata.is_normalized("NFC", char) and unicodedata.is_normalized("NFC", low):
            kinds[c] = of.get(unicodedata.category(char)[0], ODD)
            lower[c] = ord(low)
    return kinds, lower


def _powers(factor: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """factor**i and factor**-i modulo 2**64 for i < n."""
    if factor not in _powers.known or len(_powers.known[factor][0]) < n:
        inverse = np.uint64(pow(int(factor), -1, 1 << 64))
        one = np.ones(1, dtype=np.uint64)
        _powers.known[factor] = tuple(np.cumprod(np.concatenate([one, np.full(n - 1, f)]), dtype=np.uint64) for f in (factor, inverse))
    return _powers.known[factor]


_powers.known = {}


def _hashes(chars: np.ndarray, begin: np.ndarray, end: np.ndarray, factor: np.uint64) -> np.ndarray:
    """64-bit hashes of the runs chars[begin:end]."""
    up, down = _powers(factor, len(chars))
    total = np.zeros(len(chars) + 1, dtype=np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up[: len(chars)], out=total[1:])
    return mix64((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class WordIds:
    """Ids of texts. All come from the tokenizers library, each part once.

    This tokenizer drops white space and no rule of it reaches across white
    space, so a text's ids are its words' ids in order. Where its pattern parts
    letters, digits and other signs, so does this; many runs of letters go through
    one call, as each ends in the one id that ends a word. Words with a contraction
    or an ODD character are encoded whole, and so is every word where the
    tokenizer has another pattern. Texts that spell a special token are encoded
    word by word. Parts are remembered by two 64-bit hashes as long as the Python
    worker lives.
    """

    def __init__(self, path: str):
        self.tokenizer, self.dtype = tokenizer(path)
        rules = json.loads(self.tokenizer.to_str())
        self.folds = '"Lowercase"' in json.dumps(rules["normalizer"])
        suffix = rules["model"].get("end_of_word_suffix")
        self.parts = bool(suffix) and json.dumps(_PARTING) in json.dumps(rules["pre_tokenizer"])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        if self.parts:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.specials = [t["content"].lower() for t in rules["added_tokens"]]
        self.memo = HashMemo(MEMO, check=np.uint64, start=np.int64, n=np.int32)
        self.ids, self.n_ids = np.zeros(1024, self.dtype), 0

    def _encode(self, word: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype=self.dtype)

    def _encode_letters(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of runs of letters, many in a call, and how many each has."""
        out, sizes = [], []
        for some in in_slices(words, len, CALL):
            ids = self._encode(" ".join(some))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):  # folding has made a sign of a letter
                each = list(map(self._encode, some))
                ids, cuts = np.concatenate(each), np.cumsum(list(map(len, each)))
            out.append(ids)
            sizes.append(np.diff(cuts, prepend=0))
        return out, sizes

    def _runs(self, chars: np.ndarray):
        """Begins and ends of the parts, which of them are letters, and the
        characters with case folded where that changes nothing."""
        kinds, lower = _characters()
        low = np.where(chars < len(kinds), chars, 0)
        kind = np.where(chars < len(kinds), kinds[low], ODD)
        word = kind != SPACE
        begins = word & np.concatenate([[True], ~word[:-1]])
        number = np.cumsum(begins) - 1
        whole = kind == ODD
        if self.parts:  # an apostrophe may begin a contraction
            quote = np.flatnonzero(chars[:-1] == 39)
            whole[quote[np.isin(chars[quote + 1] | np.uint32(32), np.frombuffer(b"stmdrvl", np.uint8))]] = True
            odd = np.zeros(int(begins.sum()) + 1, dtype=bool)
            odd[number[whole & word]] = True
            inside = word & ~odd[number]
            changed = np.concatenate([[True], kind[1:] != kind[:-1]])
            begins |= inside & (changed | (kind == DIGIT))
        else:
            odd, inside = np.ones(int(begins.sum()) + 1, dtype=bool), np.zeros(len(chars), dtype=bool)
        begin = np.flatnonzero(begins)
        gap = np.concatenate([np.flatnonzero(~word), [len(chars)]])
        end = np.minimum(np.concatenate([begin[1:], [len(chars)]]), gap[np.searchsorted(gap, begin)])
        folded = np.where(inside, lower[low], chars) if self.folds else chars
        return begin, end, (kind[begin] == LETTER) & inside[begin], folded

    def _parts_of(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\n".join(texts) + "\n"
        chars = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        begin, end, letters, folded = self._runs(chars)
        keys, checks = (_hashes(folded, begin, end, f) for f in _FACTORS)
        source = folded.astype("<u4").tobytes().decode("utf-32-le")
        if self.memo.n > self.memo.limit:
            self.n_ids = 0

        def learn(first):
            many = letters[first]
            first = np.concatenate([first[many], first[~many]])
            parts = [source[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())]
            ids, sizes = self._encode_letters(parts[: int(many.sum())])
            rest = list(map(self._encode, parts[int(many.sum()) :]))
            ids, sizes = ids + rest, np.concatenate([*sizes, np.array(list(map(len, rest)), dtype=np.int64)])
            starts = self.n_ids + np.cumsum(sizes) - sizes
            self.n_ids += int(sizes.sum())
            if self.n_ids > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), self.n_ids), self.dtype)])
            self.ids[self.n_ids - int(sizes.sum()) : self.n_ids] = np.concatenate(ids)
            back = np.argsort(np.concatenate([np.flatnonzero(many), np.flatnonzero(~many)]))
            return {"check": checks[first[back]], "start": starts[back], "n": sizes[back]}

        rows = self.memo.rows(keys, learn)
        n, start = self.memo["n"][rows].astype(np.int64), self.memo["start"][rows]
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.ids[np.arange(total[-1]) + np.repeat(start - total[:-1], n)]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        cuts = total[np.searchsorted(begin, np.cumsum(lengths))]
        found = np.split(out, cuts[:-1]) if len(texts) else []
        clash = np.flatnonzero(self.memo["check"][rows] != checks)  # two parts with one hash
        for t in np.unique(np.searchsorted(np.cumsum(lengths), begin[clash], side="right")):
            found[t] = self._by_words(texts[t])
        return found

    def _by_words(self, text: str) -> np.ndarray:
        ids = [self._encode(w.decode()) for w in text.encode().split()]
        return np.concatenate(ids) if ids else np.zeros(0, self.dtype)

    def of(self, texts: list[bytes]):
        """The ids of each text, in order."""
        for some in in_slices(texts, len, SLICE):
            some = [t.decode("utf-8", "replace") for t in some]
            plain = [not any(s in low for s in self.specials) for low in map(str.lower, some)]  # the spelling of special tokens matters
            found = iter(self._parts_of([t for t, p in zip(some, plain) if p]))
            for t, p in zip(some, plain):
                yield next(found) if p else self._by_words(t)


def word_ids(path: str) -> WordIds:
    """The worker's memory for a tokenizer."""
    return worker_memory(("ids", path), lambda: WordIds(path))
