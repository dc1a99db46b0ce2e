"""Byte-level BPE over Python strings: pre-tokens, merges and what can be proved about them.

Texts split into *chunks* at single spaces between two non-space characters.  No match of the
pre-token pattern reaches over such a space (only ``\\s+`` could, and it needs a second white-space
character or the text's end), so chunks encode independently and can be remembered by their text.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

PRE_TOKEN = regex.compile(public_tokenizers.PATTERN)
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
ODD_EDGE = re.compile(r"\s | \s")


def byte_of_symbol() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies, and back."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def ranks_of_json(path: str) -> dict[bytes, int]:
    """Token bytes to id, for a vocabulary whose ids follow the order of its merges.

    That order is checked here (the n-th merge makes the id 256 + n), so merging by lowest id is the
    same as merging by the library's merge list.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model["added_tokens"]}
    model, back = model["model"], byte_of_symbol()
    vocab = model["vocab"]
    for n, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        if vocab[left + right] != 256 + n:
            raise ValueError(f"merge {n} of {path} doesn't make id {256 + n}")
    return {bytes(back[c] for c in s): i for s, i in vocab.items() if s not in special}


def ranks_of_tiktoken(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}


def prove_single_tokens(path: str) -> set[str]:
    """The vocabulary strings that, standing alone as one pre-token, encode as one token.

    Each string is shown to be one match of the pattern and is encoded by the library itself.
    Tokens that aren't whole UTF-8 can't be a pre-token and are left out.
    """
    tokenizer = Tokenizer.from_file(path)
    strings = []
    for token in ranks_of_json(path):
        try:
            text = token.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if PRE_TOKEN.findall(text) == [text]:
            strings.append(text)
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    return {s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1}


@lru_cache(maxsize=4)
def encoding_of(path: str) -> tiktoken.Encoding:
    """Once for each Python worker."""
    ranks = ranks_of_json(path) if path.endswith(".json") else ranks_of_tiktoken(path)
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def unlike_characters() -> dict[str, frozenset[str]]:
    """Class -> characters that tiktoken's pattern engine has in it and the one here hasn't, or the other way round.

    The two carry different Unicode versions.  An encoding of single bytes whose pattern is the class drops all else.
    """
    single, every = {bytes([i]): i for i in range(256)}, "".join(chr(c) for c in range(128, 0x110000) if not 0xD800 <= c <= 0xDFFF)
    found = {}
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        e = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=single, special_tokens={})
        found[kind] = frozenset(set(e.decode(e.encode_ordinary(every))) ^ set(regex.findall(kind, every)))
    return found


@lru_cache(maxsize=1)
def tiktoken_split() -> tuple[frozenset[str], regex.Pattern]:
    """The characters that the two engines class differently, and the pattern with tiktoken's classes spelled out."""
    pattern, unlike = public_tokenizers.PATTERN, unlike_characters()
    for kind, characters in unlike.items():
        codes = sorted(map(ord, characters))
        first = [c for c in codes if chr(c - 1) not in characters]
        last = [c for c in codes if chr(c + 1) not in characters]
        ranges = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last, strict=True))
        if ranges:
            pattern = pattern.replace(kind, f"[{kind}~~[{ranges}]]")
    return frozenset().union(*unlike.values()), regex.compile(pattern, regex.V1)


class LibraryClasses:
    """Whether the tokenizers library and the pattern engine here put a text's characters in one class.

    The two carry different Unicode versions.  Every character is probed once, after a letter, a
    digit, a symbol and a line end; a text with a character that splits differently is left to
    the library as a whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        specials = "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))
        self.split = re.compile(f"({specials or '(?!)'})")  # without special tokens nothing splits
        self.same: set[str] = {chr(c) for c in range(128)}
        self.other: set[str] = set()

    def doubtful(self, text: str) -> bool:
        if text.isascii():
            return False
        seen = set(text)
        for c in seen - self.same - self.other:
            probes = [before + c for before in "a1!\n"]
            here = [len(PRE_TOKEN.findall(p)) for p in probes]
            there = [len(self.tokenizer.pre_tokenizer.pre_tokenize_str(p)) for p in probes]
            (self.same if here == there else self.other).add(c)
        return not self.other.isdisjoint(seen)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def chunks_of(text: str) -> list[str]:
    """The text cut before every space between two non-space characters; nothing is dropped."""
    if ODD_EDGE.search(text) or text[:1] == " " or text[-1:] == " ":
        first, *rest = SAFE_SPACE.split(text)
    else:
        first, *rest = text.split(" ")
    return [first, *map(" ".__add__, rest)] if first else []
