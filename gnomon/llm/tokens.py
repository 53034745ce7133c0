"""Token ids by a tokenizers file, with each distinct run of text encoded once.

A tokenizer of the two kinds known here cuts a text at white space before anything else, so what lies between two cuts
has the same ids wherever it stands. Each distinct piece goes through the tokenizer's own model once and is then looked
up. Texts with characters outside the Latin letters, digits and common marks, or with the text of a special token, and
all texts of tokenizers of another kind, are encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import regex

from gnomon.llm.common import mix, spans

_GPT2 = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_CLIP_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CLIP = regex.compile(_CLIP_PATTERN)
_OTHER = regex.compile("[^\\x00-\\x1b\\x20-ɏ‐-‧‰-⁞€]")
#: Bytes of characters beyond U+027F and of U+001C to U+001F.
_PLAIN = bytes(b for b in range(256) if b < 0xCA and not 0x1C <= b <= 0x1F)
_BLANKS = (b"\t", b"\x0b", b"\x0c", b"\r")
_GAPS = re.compile(rb"^\s|\s\s|\s\Z")
_UNIT = regex.compile(r"\s*\S+|\s+")


def _byte_chars() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_CHARS = dict(enumerate(_byte_chars()))
_SPACE = _CHARS[32]
#: What tells runs behind a space, behind nothing and behind a line end apart.
_LEAD = np.array([0, 0xA5A5A5A5C3C3C3C3, 0x5A5A1B2C3D4E5F61], np.uint64)
#: ASCII marks but the apostrophe: a run of them behind a word is one piece.
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)


class Encoder:
    """Encodes batches of texts.

    What it remembers is bounded: a table of `slots` places for runs between white space, in which a later run takes the
    place of an earlier one, and at most `most` pieces.
    """

    def __init__(self, path: str, slots: int = 1 << 21, most: int = 50_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        self.kind, self.most, self.slots = self._kind(spec), most, slots
        self.pieces: dict[str, list[int]] = {}
        self._newline = [t.id for t in self.tokenizer.model.tokenize(_CHARS[10])] if self.kind == "space" else []
        self.clear()

    @staticmethod
    def _kind(spec: dict) -> str:
        if spec["model"].get("type") != "BPE" or spec["model"].get("dropout") or spec["model"].get("ignore_merges"):
            return "other"
        cut, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if cut.get("type") == "ByteLevel" and not cut["add_prefix_space"] and cut["use_regex"] and norm is None:
            return "space"
        if cut.get("type") == "Sequence" and [x["type"] for x in cut["pretokenizers"]] == ["Split", "ByteLevel"] and cut["pretokenizers"][0]["pattern"] == {"Regex": _CLIP_PATTERN} and not cut["pretokenizers"][1]["use_regex"] and [x["type"] for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            return "lower"
        return "other"

    def clear(self) -> None:
        self.keys = np.zeros((2, self.slots), np.uint64)
        self.begin, self.size = np.zeros(self.slots, np.int64), np.zeros(self.slots, np.int32)
        self.flat, self.used = np.empty(1 << 20, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32), 0

    def _mapped(self, mapped: str) -> list[int]:
        """Ids of a piece in the model's alphabet."""
        ids = self.pieces.get(mapped)
        if ids is None:
            if len(self.pieces) >= self.most:
                self.pieces.clear()
            ids = self.pieces[mapped] = [t.id for t in self.tokenizer.model.tokenize(mapped)]
        return ids

    def _piece(self, piece: str) -> list[int]:
        return self._mapped(piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(_CHARS))

    def _new(self, words: list[bytes], first: list[int]) -> list[list[int]]:
        """Ids of runs that the table does not hold, behind a space (0), nothing (1) or a line end (2). Most are letters, with marks behind them or without."""
        lower, mapped, out = self.kind == "lower", self._mapped, []
        for w, f in zip(words, first, strict=True):
            head = w.rstrip(_MARKS)
            mark = w[len(head) :].decode()
            if head.isalpha():
                s = (head.lower() if lower else head).decode()
            elif (s := head.decode().lower() if lower else head.decode()).isalpha():
                s = (s.encode() if lower else head).decode("latin-1").translate(_CHARS)
            else:
                out.append(self._newline * (f == 2) + self._run(" " * (f == 0 and not lower) + w.decode()))
                continue
            ids = mapped(s if f or lower else _SPACE + s)
            ids = ids + mapped(mark) if mark else ids
            out.append(self._newline + ids if f == 2 else ids)
        return out

    def _run(self, run: str) -> list[int]:
        if self.kind == "lower":
            run = run.lower()
            found = [run] if run.isalpha() else _CLIP.findall(run)
        else:
            found = [run] if run[1:].isalpha() and (run[0] == " " or run[0].isalpha()) else _GPT2.findall(run)
        return self._piece(found[0]) if len(found) == 1 else [i for p in found for i in self._piece(p)]

    def _whole(self, text: bytes) -> list[int]:
        """Of one text that needs more care than the table gives."""
        s = text.decode("utf-8", "replace")
        if self.kind == "other" or _OTHER.search(s) or any(x in text for x in self.special):
            return self.tokenizer.encode(s, add_special_tokens=False).ids
        return [i for run in (s.split() if self.kind == "lower" else _UNIT.findall(s)) for i in self._run(run)]

    def _plain(self, text: bytes) -> bool:
        """Whether the table can serve: no character beyond U+027F, no white space or control that needs care, no special token."""
        if self.kind == "other" or text.translate(None, _PLAIN) or b"\xc2\x85" in text or b"\xc2\xa0" in text or any(x in text for x in self.special):
            return False
        if self.kind == "lower":
            return True
        single = len(text.split()) == text.count(b" ") + text.count(b"\n") + 1 and not any(x in text for x in _BLANKS)
        return text[0] > 32 and text[-1] > 32 and (single or not _GAPS.search(text))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        plain = [bool(x) and self._plain(x) for x in texts]
        some = [x for x, p in zip(texts, plain, strict=True) if p]
        ids, many = self._table(some) if some else (np.empty(0, np.uint32), np.empty(0, np.int64))
        if len(some) == len(texts):
            return ids, many
        out, parts, at, k = np.zeros(len(texts), np.int64), [], 0, 0
        for i, (x, p) in enumerate(zip(texts, plain, strict=True)):
            if p:
                out[i] = many[k]
                k += 1
                parts.append(ids[at : at + out[i]])
                at += out[i]
            elif x:
                parts.append(np.array(self._whole(x), np.uint32))
                out[i] = len(parts[-1])
        return np.concatenate(parts) if parts else np.empty(0, np.uint32), out

    def _table(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b" ".join(texts) + b" "
        joined = np.frombuffer(raw, np.uint8)
        of_doc, starts, lens, (low, high) = spans(texts, joined, 2, self.kind == "space")
        first = np.zeros(len(starts), np.int8)
        if self.kind == "space":
            first[joined[starts - 1] == 10] = 2
            first[of_doc[:-1]] = 1
            low = low ^ _LEAD[first]
        if self.used > 1 << 24:
            self.clear()
        slot = (low & np.uint64(self.slots - 1)).view(np.int64)
        miss = np.flatnonzero((self.keys[0][slot] != low) | (self.keys[1][slot] != high) | (self.size[slot] == 0))
        begin, size = self.begin[slot], self.size[slot].astype(np.int64)
        if len(miss):
            _, one, back = np.unique(low[miss] ^ mix(high[miss]), return_index=True, return_inverse=True)
            at = miss[one]
            runs = self._new([raw[s : s + n] for s, n in zip(starts[at].tolist(), lens[at].tolist(), strict=True)], first[at].tolist())
            long = np.fromiter(map(len, runs), np.int64, len(runs))
            total = int(long.sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            self.flat[self.used : self.used + total] = np.fromiter((i for r in runs for i in r), self.flat.dtype, total)
            where = self.used + np.cumsum(long) - long
            self.used += total
            begin[miss], size[miss] = where[back], long[back]
            put = slot[at]  # of two new runs with one place the last stays, in all arrays alike
            self.begin[put], self.size[put] = where, long
            self.keys[0][put], self.keys[1][put] = low[at], high[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(begin - (ends - size), size)].astype(np.uint32)
        return ids, np.diff(np.concatenate([[0], ends])[of_doc])


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """This process's encoder of a tokenizer file: a path, or the name of one of the public tokenizers."""
    if name not in _encoders:
        path = name
        if not os.path.isabs(name):
            import public_tokenizers

            path = public_tokenizers.path(name)
        _encoders[name] = Encoder(path)
    return _encoders[name]


def with_end(ids: np.ndarray, many: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text."""
    return np.insert(ids, np.cumsum(many), np.uint32(end)), many + 1
