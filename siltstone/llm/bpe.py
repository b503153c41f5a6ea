"""BPE encoding and decoding: byte pairs inside no vocabulary token mark certain cuts; fragments are encoded one by one."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

#: Fragments or words whose ids a worker keeps, and bytes of them and their ids; beyond either they are forgotten and encoded anew.
KEPT, KEPT_BYTES = 500_000, 16_000_000


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _white_tails() -> np.ndarray:
    """[x, y]: do the bytes x, y end a white-space character of two bytes or more?"""
    out = np.zeros((256, 256), bool)
    for i in range(0x80, 0x3100):
        if chr(i).isspace():
            out[tuple(chr(i).encode()[-2:])] = True
    return out


class Codec:
    """A byte-level vocabulary of the tokenizers library, used fragment by fragment.

    A cut between two bytes is certain if no token holds them side by side: no merge crosses it. Cuts are taken only where
    splitting the text changes none of the words that the vocabulary's pattern finds: never after white space (a run of it
    looks ahead), within a character, or before an apostrophe that follows no ASCII letter or digit (it could begin a contraction).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        described = json.loads(self.tokenizer.to_str())
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.separator = min(self.special, default=None, key=self.special.get)
        alphabet = byte_alphabet()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = [b""] * (max([*vocabulary.values(), *self.special.values()]) + 1)
        inside = np.zeros((256, 256), bool)
        for token, i in vocabulary.items():
            if token not in self.special:
                self.bytes_of[i] = raw = bytes(alphabet[c] for c in token)
                inside[tuple(np.frombuffer(raw[:-1], np.uint8)), tuple(np.frombuffer(raw[1:], np.uint8))] = True
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        cut = ~inside
        cut[[i for i in range(128) if chr(i).isspace()], :] = False
        cut[:, 0x80:0xC0] = False
        cut[[i for i in range(256) if not (i < 128 and chr(i).isalnum())], 0x27] = False
        self.cut, self.white = cut, _white_tails()
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def fragments(self, raw: bytes) -> list[bytes]:
        if len(raw) < 2:
            return [raw] if raw else []
        a = np.frombuffer(raw, np.uint8)
        at = self.cut[a[:-1], a[1:]]
        at[1:] &= ~self.white[a[:-2], a[1:-1]]
        ends = [0, *(np.flatnonzero(at) + 1).tolist(), len(raw)]
        return [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def learn(self, fragments: set[bytes]) -> None:
        """Ids of fragments that aren't known yet; a special token between two keeps them apart."""
        if len(self.known) > KEPT or self.held > KEPT_BYTES:
            self.known.clear()
            self.held = 0
        new = [f for f in fragments if f not in self.known]
        self.held += 3 * sum(map(len, new))
        if self.separator is None:
            for f in new:
                self.known[f] = np.array(self.tokenizer.encode(f.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            return
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            ids = np.array(self.tokenizer.encode(self.separator.join(f.decode() for f in part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(ids == self.special[self.separator])
            for f, a, b in zip(part, [0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)], strict=True):
                self.known[f] = ids[a:b].tobytes()

    def pieces(self, text: str) -> list[bytes | int]:
        """Fragments, and ids of special tokens where the text spells them."""
        out: list[bytes | int] = [text]
        for token, i in self.special.items():
            if token in text:
                split: list = []
                for part in out:
                    if isinstance(part, str):
                        for k, x in enumerate(part.split(token)):
                            split += [i, x] if k else [x]
                    else:
                        split.append(part)
                out = split
        return [y for x in out for y in ([x] if isinstance(x, int) else self.fragments(x.encode()))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text the ids, as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t) for t in texts]
        plain = [all(type(x) is bytes for x in p) for p in cut] if any(s in t for t in texts for s in self.special) else [True] * len(cut)
        self.learn({x for p in cut for x in p if type(x) is bytes})
        known = self.known
        return [b"".join(map(known.__getitem__, p)) if ok else b"".join(known[x] if type(x) is bytes else np.array([x], "<u4").tobytes() for x in p) for p, ok in zip(cut, plain, strict=True)]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: its ids (column ``ids``, unless ``with_ids`` is false), their digest and that of the text decoded from them.

    A null text counts as empty and has no ids. A text may spell special tokens; they get their ids, as in the library. Repeated
    rows give equal rows; an empty table gives none. Columns other than the two named aren't read.
    """

    def make():
        codec = Codec(path)

        def work(texts):
            ids = codec.encode([t or "" for t in texts])
            out = {"n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in ids]}
            return out | ({"ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]} if with_ids else {})

        return work

    return map_texts(docs, [id_col], text_col, make, SCHEMA + ", ids array<int>" * with_ids)


class WordCodec:
    """A vocabulary with word ends that drops white space and case: words between blanks are encoded one by one and kept.

    Words of plain lower- and upper-case Latin letters, digits and ASCII signs are encoded from the vocabulary's merge ranks;
    all others by the tokenizers library itself.
    """

    END = b"\xff"  # in no UTF-8 text; stands for the mark of a word's end

    def __init__(self, path: str):
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        described = json.loads(self.tokenizer.to_str())
        suffix, alphabet, vocabulary = described["model"]["end_of_word_suffix"], byte_alphabet(), self.tokenizer.get_vocab()

        def raw(token: str) -> bytes:
            ends = token.endswith(suffix)
            return bytes(alphabet[c] for c in (token.removesuffix(suffix) if ends else token)) + self.END * ends

        letters = sorted(alphabet, key=alphabet.get)
        order = [*letters, *(c + suffix for c in letters), *("".join(m) for m in map(lambda m: m if isinstance(m, list) else m.split(" "), described["model"]["merges"]))]
        ranks: dict[bytes, int] = {}
        self.ids: list[int] = []
        for token in order:
            if raw(token) not in ranks:
                ranks[raw(token)] = len(self.ids)
                self.ids.append(vocabulary[token])
        ranks[self.END] = len(self.ids)
        self.ids.append(-1)
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.plain = re.compile(r"[!-~À-ÖØ-öø-ÿ]*").fullmatch
        self.parts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
        self.part: dict[str, list[int]] = {}
        self.known: dict[str, bytes] = {"": b""}
        self.held = 0

    def encode_word(self, word: str) -> list[int]:
        if "<|" in word or not self.plain(word):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        out: list[int] = []
        for p in self.parts(word.lower()):
            got = self.part.get(p)
            if got is None:
                got = self.part[p] = [self.ids[i] for i in self.merge(p.encode() + self.END)]
            out += got
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text the ids, as little-endian unsigned 32-bit integers."""
        if len(self.known) > KEPT or self.held > KEPT_BYTES:
            self.known, self.held = {"": b""}, 0
            self.part.clear()
        known, out = self.known, []
        for text in texts:
            words = text.replace("\n", " ").split(" ")
            try:
                out.append(b"".join(map(known.__getitem__, words)))
                continue
            except KeyError:
                pass
            for w in set(words).difference(known):
                known[w] = np.array(self.encode_word(w), "<u4").tobytes()
                self.held += len(w) + len(known[w])
            out.append(b"".join(map(known.__getitem__, words)))
        return out
