"""Pre-tokens of the two public vocabularies, shared by encoding (8) and counting (10).

Texts of Latin letters, digits, punctuation and plain white space are split by a compiled pattern; any other text is
split by the tokenizer file's own normaliser and pre-tokeniser, so the answer never depends on a Unicode version.
"""

import json
import os
import re

LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\t\n\r "
#: Texts in which the classes above are all letters, numbers and white space there are.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ‐-‧‰-⁞₠-₿]*")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte -> the byte: printable Latin-1 bytes stand for themselves, the others follow 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def load(path: str):
    """The library's tokenizer, on one thread: Spark's tasks are the parallel part."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Splitter:
    """Splits texts into the pre-tokens of one tokenizer file; special strings come out as pre-tokens of their own."""

    def __init__(self, path: str, pattern: str, lower: bool):
        self.path, self.lower, self.loaded = path, lower, None
        self.find = re.compile(pattern).findall
        self.bytes_of = byte_alphabet()
        with open(path, encoding="utf-8") as f:
            self.specials = {t["content"] for t in json.load(f)["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials))) + ")")

    @property
    def library(self):
        """The tokenizer file's own splitter, loaded only where a text needs it."""
        if self.loaded is None:
            self.loaded = load(self.path)
        return self.loaded

    def segment(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            plain = text.lower() if self.lower else text
            if not self.lower or PLAIN.fullmatch(plain):  # some letters have their lower case beyond
                return self.find(plain)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        back = self.bytes_of
        return [bytes(back[c] for c in piece).decode("utf-8", "surrogateescape")
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def __call__(self, text: str) -> list[str]:
        if "<|" not in text:
            return self.segment(text)
        out = []
        for part in self.special.split(text):
            if part in self.specials:
                out.append(part)
            elif part:
                out += self.segment(part)
        return out


def byte_level(path: str) -> Splitter:
    """Pre-tokens of the byte-level vocabulary: words with their leading blank."""
    other = f"[^{SPACE}{LETTER}{NUMBER}]"
    return Splitter(path, f" ?[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBER}]+| ?{other}+"
                          f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+", False)


def word_level(path: str) -> Splitter:
    """Pre-tokens of the vocabulary with word ends: lower case, white space dropped, digits one by one."""
    return Splitter(path, f"[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+", True)
