"""Whole-text encoding with a public byte-level BPE file, sped up by encoding each distinct piece of text once."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import kept

#: The characters with the Unicode property White_Space, which the pre-tokenizer's pattern calls \s.
WHITE_SPACE = " \\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


LONGEST = 64  # characters of a piece that is kept; longer ones are encoded anew each time, so that the cache is bounded in bytes


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    A byte-level pre-tokenizer never joins a character that isn't white space to white space that follows it,
    so a text cut before each run of white space gives the same ids piece by piece. Pieces repeat, and each
    is encoded once while it stays in one of two generations of a cache of bounded size. A text that holds the string of an added
    token, and every text if the file asks for more than such a pre-tokenizer, is encoded as one.
    """

    def __init__(self, path: str, cache_pieces: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.older, self.cache_pieces = Tokenizer.from_file(path), {}, {}, cache_pieces
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.splits = not (spec.get("normalizer") or spec.get("truncation") or spec.get("padding") or spec["model"].get("dropout")) and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        added = [re.escape(x["content"]) for x in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(added)) if added else None
        self.blank = frozenset(chr(c) for c in range(0x3001) if re.match(f"[{WHITE_SPACE}]", chr(c)))
        self.seen, self.met = bytearray(1 << 22), 0
        most = max(self.tokenizer.get_vocab(True).values(), default=0)
        self.model, self.id_bytes = self.tokenizer.model, [i.to_bytes(4, "little") for i in range(most + 1)]
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # the pieces are cached here
        self.word_and_marks = re.compile(r"(\n?)([^\W\d_]+)([.,;:!?%*#&$|]*)").fullmatch
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level files name by their own character
        self.byte_names = {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(printed)))}
        self.pieces = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+").findall

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece_ids(self, pieces: list[str]) -> list[bytes]:
        """As ``_ids``, of pieces without added tokens; many go into one call as words of one text."""
        out = []
        for lo in range(0, len(pieces), 1000):
            words = pieces[lo : lo + 1000]
            encoding = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(encoding.ids, "<u4").tobytes()
            ends = 4 * np.cumsum(np.bincount(np.array(encoding.word_ids, np.int64), minlength=len(words)))
            at = 0
            for end in ends.tolist():
                out.append(ids[at:end])
                at = end
        return out

    def _key(self, piece: str):
        """The cache's key of a piece that the pattern found."""
        return piece[1:] if piece[:1] == " " and piece[1:2] != "\n" and piece[-1] not in self.blank else (piece,)

    def _new(self, keys: set) -> dict:
        """Values of keys that the cache doesn't hold: a string stands for itself after a space, or for itself if it
        starts with a line's end, and a 1-tuple for what it holds. A string that ends in white space or is empty isn't
        a piece; its value is None. Letters and the marks after them never share a token, so that a word with
        marks takes the ids of both. A value stays in the cache if its key, or one of the same hash, has been met before:
        most pieces come once, and would drive out those that come again."""
        cache, older, seen, out, rest = self.cache, self.older, self.seen, {}, []
        for k in keys:
            if k in older:
                out[k] = cache[k] = older[k]
                continue
            if isinstance(k, tuple):
                rest.append(k)
                continue
            if k.isalpha():
                ids = self._word(" " + k)
            elif (word := k[:-1]).isalpha() and k[-1] in ".,;:!?":
                ids = (cache.get(word) or older.get(word) or self._word(" " + word)) + self._literal(k[-1])
            elif not k or k[-1] in self.blank:
                out[k] = None
                continue
            elif (found := self.word_and_marks(k)) and found[2].isalpha():
                line, word, marks = found.groups()
                if line:
                    ids = self._literal(line) + self._word(word)
                else:
                    ids = cache.get(word) or older.get(word) or self._word(" " + word)
                ids = ids + self._literal(marks) if marks else ids
            else:
                rest.append(k)
                continue
            out[k] = ids
            if len(k) > LONGEST:
                continue
            at = hash(k) & 0x3FFFFF
            if seen[at]:
                cache[k] = ids
            else:
                seen[at] = 1
                self.met += 1
        if self.met > 1 << 20:
            self.seen, self.met = bytearray(1 << 22), 0
        if rest:
            found = dict(zip(rest, self._piece_ids([k[0] if isinstance(k, tuple) else k if k[0] == "\n" else " " + k for k in rest])))
            cache.update((k, ids) for k, ids in found.items() if len(k[0] if isinstance(k, tuple) else k) <= LONGEST)
            out.update(found)
        return out

    def _word(self, word: str) -> bytes:
        """The ids of letters, with a space before them or not: for the pre-tokenizer, one unit."""
        if word.isascii():
            named = "\u0120" + word[1:] if word[0] == " " else word
        else:
            named = word.encode().decode("latin-1").translate(self.byte_names)
        id_bytes = self.id_bytes
        return b"".join([id_bytes[t.id] for t in self.model.tokenize(named)])

    def _literal(self, marks: str) -> bytes:
        if len(marks) > LONGEST:
            return self._piece_ids([marks])[0]
        if (marks,) not in self.cache:
            self.cache[(marks,)] = self._piece_ids([marks])[0]
        return self.cache[(marks,)]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, text in enumerate(texts) if not self.splits or self.added and self.added.search(text)]
        out: list = [None] * len(texts)
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]) if whole else []):
            out[i] = ids
        for i, text in enumerate(texts):
            if out[i] is None:
                out[i] = self._joined(text)
        return out

    def _joined(self, text: str) -> bytes:
        if len(self.cache) > self.cache_pieces:
            self.older, self.cache = self.cache, {}
        get = self.cache.get
        keys: list = text.replace("\n", " \n").split(" ")  # right unless white space stands before a space or a line's end
        if keys[0][-1:] in self.blank:
            return self._by_pattern(text)
        keys[0] = (keys[0],)
        found = [get(k) for k in keys]
        if None in found:
            new = [i for i, x in enumerate(found) if x is None]
            got = self._new({keys[i] for i in new})
            if None in got.values():
                return self._by_pattern(text)
            for i in new:
                found[i] = got[keys[i]]
        return b"".join(found)

    def _by_pattern(self, text: str) -> bytes:
        keys = [self._key(p) for p in self.pieces(text)]
        got = self._new({k for k in keys if k not in self.cache})
        return b"".join([got[k] if k in got else self.cache[k] for k in keys])


def encoder(path: str) -> PieceEncoder:
    """The encoder of a worker process, kept from task to task."""
    return kept(("encoder", path), lambda: PieceEncoder(path))
