"""Token ids by a public byte-level BPE vocabulary, given as a tokenizers JSON file."""

from __future__ import annotations

import json
from functools import cache

import numpy as np

VOCABULARY = "byte_bpe_50k.json"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_of_character() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE files use for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def encoder(path: str):
    """A function from a text to its 32-bit ids: those of Tokenizer.from_file(path).encode(text, add_special_tokens=False).

    A special string in a text (<|endoftext|>) is thus one id, as the library has it. Where the file is plain
    byte-level BPE whose ids are the merges' ranks, a faster library reads the same vocabulary (equal ids); any other
    file, a text that holds a special string, and a text on which that fails, go to the tokenizers library.
    """
    library: list = []

    def plain(text: str) -> np.ndarray:
        if not library:  # large, and seldom needed
            from tokenizers import Tokenizer

            library.append(Tokenizer.from_file(path))
        return np.array(library[0].encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as f:
        form = json.load(f)
    model, before = form["model"], form.get("pre_tokenizer") or {}
    vocab, merges = model.get("vocab", {}), model.get("merges", [])
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    simple = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not form.get("normalizer") and not model.get("dropout")
    if not simple or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return plain
    import tiktoken

    of = _byte_of_character()
    special = {x["content"] for x in form.get("added_tokens", [])}
    ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def encode(text: str) -> np.ndarray:
        if any(x in text for x in special):
            return plain(text)
        try:
            return fast(text, disallowed_special=())
        except BaseException as e:  # its matcher gives up on some very long runs of one kind
            if isinstance(e, KeyboardInterrupt | SystemExit):
                raise
            return plain(text)

    return encode


def encode(path: str, texts: list[str | None]) -> list[np.ndarray]:
    """32-bit ids of each text; null as empty."""
    one = encoder(path)
    return [one(t) if t else np.zeros(0, np.uint32) for t in texts]
