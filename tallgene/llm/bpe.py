"""Byte-pair vocabularies: splitting text into pre-tokens and merging ragged arrays of symbols."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

NO_RANK = np.iinfo(np.int64).max
#: Characters for which Python's and the tokenizer's classes, cases and normal forms agree; other texts are split by the tokenizer itself.
PLAIN = "".join(map(chr, [9, 10, 13, *range(0x20, 0x7F), *range(0xA0, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]))


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in PLAIN if unicodedata.category(c)[0] == kind)


_L, _N = _class("L"), _class("N")
_ODD = re.compile(f"[^{re.escape(PLAIN)}]")
#: The two public split patterns, with explicit classes for PLAIN.
_BYTE_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_WORD_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """One vocabulary file in the tokenizers format: byte-level symbols, merges by rank, optional word-end suffix.

    Symbols that one pair only produces make it exact to merge all places of a word's lowest-rank pair at once:
    a pair with the new symbol always ranks later. Files that break this are refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = _byte_letters()
        self.first = np.zeros(256, np.int64)  # symbol of a byte inside a word
        self.last = np.zeros(256, np.int64)  # symbol of a word's last byte
        for c, b in letters.items():
            self.first[b], self.last[b] = vocab[c], vocab[c + suffix]
        self.letters = letters
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._check(left, right, made)
        order = np.argsort(left << 20 | right)
        self.keys, self.ranks = (left << 20 | right)[order], np.arange(len(made))[order]
        self.made = made
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._lower = spec["normalizer"] is not None
        self._split = _WORD_SPLIT if self._lower else _BYTE_SPLIT
        self._own = Tokenizer.from_file(path)

    @staticmethod
    def _check(left, right, made) -> None:
        rank = np.full(int(max(left.max(), right.max(), made.max())) + 1, -1, np.int64)
        rank[made] = np.arange(len(made))
        if len(np.unique(made)) < len(made) or (np.maximum(rank[left], rank[right]) >= np.arange(len(made))).any():
            raise ValueError("a symbol with two sources, or a pair that ranks before its parts")

    def pieces(self, text: str) -> list[str]:
        """Ordinary pre-tokens and, as they stand, special tokens, in order. Word-form vocabularies get lower-cased words."""
        if self._special is None or "<|" not in text:
            return self._plain_pieces(text)
        out: list[str] = []
        for i, part in enumerate(self._special.split(text)):
            out += [part] if i % 2 else self._plain_pieces(part)
        return out

    def _plain_pieces(self, text: str) -> list[str]:
        if _ODD.search(text) is None:
            return self._split.findall(text.lower() if self._lower else text)
        if self._lower:
            text = self._own.normalizer.normalize_str(text)
        shown = (p for p, _ in self._own.pre_tokenizer.pre_tokenize_str(text))
        return [bytes(self.letters[c] for c in p).decode("utf-8", "surrogateescape") for p in shown]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of every word, flat, and how many each word keeps.

        Rounds over all words at once: each word's lowest rank among neighbouring symbols is found, all its places are
        joined from the left, and only ranks beside a joined place are looked up again. Settled words leave the arrays.
        """
        coded = [w.encode("utf-8", "surrogateescape") for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        raw = np.frombuffer(b"".join(coded), np.uint8)
        counts = np.zeros(len(words), np.int64)
        if not len(raw):
            return np.zeros(0, np.int64), counts
        sym, row = self.first[raw], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes)[sizes > 0] - 1
        sym[ends] = self.last[raw[ends]]
        rank = np.full(len(sym), NO_RANK, np.int64)  # of the pair that starts here
        rank[:-1] = np.where(row[:-1] == row[1:], self._rank(sym[:-1], sym[1:]), NO_RANK)
        done_sym, done_row = [], []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            low = np.minimum.reduceat(rank, starts)
            length = np.diff(np.r_[starts, len(sym)])
            settled = np.repeat(low == NO_RANK, length)
            if settled.any():
                done_sym.append(sym[settled])
                done_row.append(row[settled])
                sym, row, rank = sym[~settled], row[~settled], rank[~settled]
                length, low = length[low != NO_RANK], low[low != NO_RANK]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, length)
            at = np.flatnonzero(hit)
            run = np.r_[True, at[1:] != at[:-1] + 1]  # "aaa": take every second place of a run
            begin = at[np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))]
            at = at[(at - begin) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[at]
            sym, row, rank = sym[keep], row[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                inside = i + 1 < len(sym)
                inside[inside] = row[i[inside]] == row[i[inside] + 1]
                rank[i] = NO_RANK
                rank[i[inside]] = self._rank(sym[i[inside]], sym[i[inside] + 1])
        sym, row = np.concatenate(done_sym), np.concatenate(done_row)
        order = np.argsort(row, kind="stable")
        counts += np.bincount(row, minlength=len(words))
        return sym[order], counts


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """A vocabulary, once for each Python worker."""
    return ByteBpe(path)
