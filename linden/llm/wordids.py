"""Token ids of whole texts by a ``tokenizers`` vocabulary, a word at a time.

White space separates tokens of these vocabularies and Unicode composition
never crosses a space, so the ids of a text are the ids of its
space-separated words in a row.  A word goes through the library when it is
first met; texts are then put together with array gathers.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import chain

import numpy as np

SENTENCE_ENDS = tuple(".!?…。！？")
#: A control character that is a token of its own between words.
MARK = "\x01"
#: Finds characters beyond plain Latin text.  Without them, lower-casing a word
#: first changes no id (nothing composes, and each letter has one lower form),
#: unless it then holds an added token: the library finds those in the raw word.
BEYOND = re.compile("[^\x00-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e]").search
#: Words of these letters alone are in normal form and one piece each before
#: merging, so that the library's normaliser and pattern have nothing to do.
LETTERS = re.compile("\n?[a-z\u00df-\u00f6\u00f8-\u00ff\u0153]+").fullmatch
SHORT = 7
#: One of these behind a letter is always a token of its own.
TAILS = tuple(".,")


def ends_in_letter(word: str) -> bool:
    """Whether the word still ends in a letter once lower-cased and composed:
    some letters become a letter and a mark, and a mark joins what follows."""
    return unicodedata.normalize("NFC", word.lower())[-1:].isalpha()


class Codes(dict):
    """Numbers words in the order they are met."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        self.fresh.append(word)
        return code


def without_patterns(tokenizer):
    """For ``LETTERS`` words: the tokenizer without its normaliser and with
    white space in place of its pattern, or itself if it is built otherwise."""
    from tokenizers import Tokenizer

    rules = json.loads(tokenizer.to_str())
    steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
    kinds = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
    if [x["type"] for x in steps] != ["Split", "ByteLevel"] or not {*kinds} <= {"NFC", "Replace", "Lowercase"} \
            or "|[\\p{L}]+|" not in steps[0]["pattern"].get("Regex", ""):
        return tokenizer
    rules["normalizer"], steps[0] = None, {"type": "WhitespaceSplit"}
    return Tokenizer.from_str(json.dumps(rules))


class WordIds:
    """Encoder that remembers words; beyond ``memory`` entries it forgets the
    longer ones, which seldom come again."""

    def __init__(self, path: str, memory: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = without_patterns(self.tokenizer)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.tails = {c: self.tokenizer.encode(c, add_special_tokens=False).ids[0] for c in TAILS}
        self.memory = memory
        self.forget()

    def forget(self) -> None:
        self.code = Codes()
        self.flat = np.zeros(0, np.uint32)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ends = np.zeros(0, bool)
        self.breaks = np.zeros(0, bool)

    def trim(self) -> None:
        """Keep the words of at most ``SHORT`` characters, or none if those
        are most of the memory."""
        kept = [(w, c) for w, c in self.code.items() if len(w) <= SHORT]
        if len(kept) > self.memory // 2:
            self.forget()
            return
        at = np.array([c for _, c in kept], np.int64)
        size = self.size[at]
        upto = np.cumsum(size)
        self.flat = self.flat[np.repeat(self.begin[at] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]
        self.begin, self.size, self.ends, self.breaks = upto - size, size, self.ends[at], self.breaks[at]
        self.code = Codes()
        self.code.update((w, k) for k, (w, _) in enumerate(kept))

    def encode_words(self, words: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and their number for each word."""
        batch = lambda texts: [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.mark) != 1 or any(MARK in w for w in words):
            found = batch(words)
            return np.concatenate(found), np.array([len(x) for x in found], np.int64)
        joined = [f" {MARK} ".join([*words[k:k + 100], ""]) for k in range(0, len(words), 100)]
        ids = np.concatenate(batch(joined))
        marks = ids == self.mark[0]
        return ids[~marks], np.diff(np.flatnonzero(marks), prepend=-1) - 1

    def learn(self) -> None:
        """Encode the words met since the last call.  A word with a full stop
        or comma behind a letter is put together from its two parts."""
        code, first = self.code, len(self.size)
        tailed, bases, plain, other = [], [], [], []
        for w in code.fresh:  # a base not met before is appended, and so reached too
            if w.endswith(TAILS) and (LETTERS(w[:-1]) or ends_in_letter(w[:-1])):
                tailed.append(code[w])
                bases.append(code[w[:-1]])
            else:
                (plain if LETTERS(w) else other).append(code[w])
        words, code.fresh = code.fresh, []
        self.begin, self.size = np.resize(self.begin, len(code)), np.resize(self.size, len(code))
        for codes, tokenizer in ((plain, self.letters), (other, self.tokenizer)):
            at = np.array(codes, np.int64)
            ids, size = self.encode_words([words[c - first] for c in codes], tokenizer)
            assert len(size) == len(codes)
            self.begin[at], self.size[at] = len(self.flat) + np.cumsum(size) - size, size
            self.flat = np.concatenate([self.flat, ids])
        if tailed:
            at, base = np.array(tailed, np.int64), np.array(bases, np.int64)
            size = self.size[base] + 1
            upto = np.cumsum(size)
            ids = self.flat[np.minimum(np.repeat(self.begin[base] - (upto - size), size) + np.arange(upto[-1]), len(self.flat) - 1)]
            ids[upto - 1] = [self.tails[words[c - first][-1]] for c in tailed]
            self.begin[at], self.size[at] = len(self.flat) + upto - size, size
            self.flat = np.concatenate([self.flat, ids])
        self.ends = np.concatenate([self.ends, np.array([w.endswith(SENTENCE_ENDS) for w in words], bool)])
        self.breaks = np.concatenate([self.breaks, np.array([w.startswith("\n") for w in words], bool)])

    def words_of(self, text: str) -> list[str]:
        """The words of a text, lower-cased where that changes no id."""
        if BEYOND(text):
            return text.replace("\n", " \n").split(" ")
        lower = text.lower().replace("\n", " \n")
        words = lower.split(" ")
        if any(t in lower for t in self.added):
            raw = text.replace("\n", " \n").split(" ")
            words = [r if any(t in w for t in self.added) else w for w, r in zip(words, raw, strict=True)]
        return words

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row; number of ids of each text; positions
        (in the row of ids) where a sentence ends; and the texts' offsets."""
        if len(self.code) > self.memory:
            self.trim()
        words = [self.words_of(t) for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        if self.code.fresh:
            self.learn()
        size = self.size[codes]
        after = np.cumsum(size)
        total = int(after[-1]) if len(after) else 0
        ids = self.flat[np.repeat(self.begin[codes] - (after - size), size) + np.arange(total)]
        edge = np.concatenate([[0], np.cumsum(counts)])
        upto = np.concatenate([[0], after])[edge]
        stops = np.concatenate([after[self.ends[codes]], (after - size)[self.breaks[codes]]])
        return ids, np.diff(upto), np.unique(stops), upto[:-1]


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """The process's encoder of a vocabulary: tasks that follow each other in
    a worker share its word memory, which changes speed alone."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]
