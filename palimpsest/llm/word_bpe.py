"""Pre-tokens of the public ``word_bpe`` tokenizer: normaliser, special strings and splitting, without the merges.

Common scripts take a fast path that splits with the pattern of the tokenizer's own file; texts with any other character are
normalised and split by the library's normaliser and pre-tokenizer, so that both give what the library gives.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The characters that Unicode calls white space.
WHITE = "\t-\r \x85\xa0  -     　"
#: Characters that are their own composed form, and whose lower case doesn't depend on their neighbours.
PLAIN = re.compile("[\x00-ɏ‐-‧‰-⁞]*")


def byte_chars() -> dict[int, str]:
    """The visible character that byte-level vocabularies write for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PreTokenizer:
    """Splits texts into pre-tokens; a special string of the tokenizer comes out as its id (an int)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        pattern = next(x["pattern"]["Regex"] for x in self.spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        # For plain characters and all that lower() makes of them (which may lie elsewhere, as that of Ə): the same classes, spelled
        # out for the faster of the two libraries.
        plain = {x for c in (*range(0x250), *range(0x2010, 0x2060)) for x in chr(c) + chr(c).lower() if not x.isascii()}
        of = lambda kind: "".join(re.escape(x) for x in sorted(plain) if unicodedata.category(x)[0] == kind)
        spelled = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE}a-z0-9{of('L')}{of('N')}]").replace(r"\p{L}", f"a-z{of('L')}").replace(r"\p{N}", f"0-9{of('N')}")
        self.find_plain = re.compile(spelled).findall
        letters = pattern.replace(r"[^\s\p{L}\p{N}]", "[^\t-\r a-z0-9]").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
        self.find_ascii = re.compile(letters).findall
        self.special = {x["content"]: x["id"] for x in self.spec["added_tokens"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.to_byte = {ord(c): b for b, c in byte_chars().items()}
        self.to_char = byte_chars()

    def plain(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if text.isascii():
            return self.find_ascii(text.lower())
        if PLAIN.fullmatch(text):
            return self.find_plain(text.lower())
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.to_byte[ord(c)] for c in p).decode("utf-8") for p, _ in pieces]

    def pieces(self, pre_token: str) -> int:
        """How many tokens the library's merges make of a pre-token, which isn't normalised or split again."""
        return len(self.library.model.tokenize("".join(map(self.to_char.__getitem__, pre_token.encode("utf-8")))))

    def split(self, text: str) -> list:
        if self.cut is None or "<|" not in text:
            return self.plain(text)
        out: list = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.plain(part)
        return out


_LOADED: dict[tuple, object] = {}


def loaded(kind: type, *args):
    """One object of a kind for each Python worker."""
    if (key := (kind, *args)) not in _LOADED:
        _LOADED[key] = kind(*args)
    return _LOADED[key]
