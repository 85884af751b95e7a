"""Token ids from public vocabulary files (their folder is a parameter)."""

from __future__ import annotations

import os
import re

import numpy as np

from txrisk.llm.common import process_cache

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"
CACHE = 200_000  # chunks per generation of a worker's cache


def vocabulary_path(name: str, folder: str | None = None) -> str:
    if folder is not None:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers
    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of a word-level BPE vocabulary, white space dropped.

    The vocabulary's pre-tokenizer never joins text across white space, so a
    text's ids are the ids of its chunks between ASCII white space in order.
    Chunks recur; their ids are cached, in two generations of bounded size. To
    meet fewer different chunks, marks that end a word are set apart (a run of
    marks is a word of its own for the vocabulary, too; not ``<|>``, which occur
    in special tokens) and capitals are lowered as the vocabulary's normalizer
    does.
    """

    ENDING = re.compile(r"(?<=[a-zß-öø-ÿ])[!-&(-;=?@\[-`{}~]+(?![^\x20\x09-\x0d])")
    CHUNK = re.compile(r"[^\x20\x09-\x0d]+")
    SEPARATORS = "\x1c\x1d\x1e\x1f"   # white space for str.split, not for the vocabulary

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends_word[i] = token.endswith("</w>")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode_plain(self, chunks: list[str]) -> list[bytes] | None:
        """Ids of chunks of letters only: each is one word, so words end where
        tokens end one. None if the counts disagree."""
        ids = np.array(self.tok.encode_batch_fast([" ".join(chunks)], add_special_tokens=False)[0]
                       .ids, "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(chunks) or (len(ids) and ends[-1] != len(ids)):
            return None
        raw, cuts = ids.tobytes(), (np.concatenate([[0], ends]) * 4).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _encode_each(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        plain = [c for c in missing if c.isalpha()]
        if plain:
            out.update(zip(plain, self._encode_plain(plain) or self._encode_each(plain)))
        rest = [c for c in missing if c not in out]
        if rest:
            out.update(zip(rest, self._encode_each(rest)))
        return out

    def _chunks(self, text: str) -> list[str]:
        if any(c in text for c in self.SEPARATORS):
            return self.CHUNK.findall(text)
        return text.split()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [self._chunks(self.ENDING.sub(r" \g<0>", _lower(t))) for t in texts]
        young, old = self.young, self.old
        new = set().union(*split).difference(young)
        missing = []
        for c in new:
            v = old.get(c)
            if v is None:
                missing.append(c)
            else:
                young[c] = v
        if missing:
            young.update(self._learn(missing))
        out = [b"".join(map(young.__getitem__, chunks)) for chunks in split]
        if len(young) > CACHE:
            self.old, self.young = young, {}
        return out


_CAPITALS = {c: c + 32 for c in range(65, 91)}


def _lower(text: str) -> str:
    """Lower case where it is sure to be the vocabulary's: whole Latin-1 texts,
    else A-Z."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.translate(_CAPITALS)
    return text.lower()


def word_tokenizer(path: str) -> WordTokenizer:
    cache = process_cache()
    key = ("word", path)
    if key not in cache:
        cache[key] = WordTokenizer(path)
    return cache[key]


def byte_encoding(path: str, pattern: str):
    """A byte-level BPE encoding without special tokens (ids decode losslessly)."""
    cache = process_cache()
    key = ("byte", path)
    if key not in cache:
        import base64

        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache[key] = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks,
                                       special_tokens={})
    return cache[key]
