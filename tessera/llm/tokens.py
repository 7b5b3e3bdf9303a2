"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import functools
import json
import os

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The split of byte-level BPE, as the tokenizers library has it built in (a fixed value).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes, without special tokens added.

    The ids are those of the tokenizers library. If the file is plain byte-level BPE whose ids follow the order of its merges,
    tiktoken finds the same ids several times faster; texts with a special token of the file always go the first way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or ()]
        self.fast = self._ranked(spec)

    @staticmethod
    def _ranked(spec: dict):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            return None
        vocab, signs = model["vocab"], _byte_signs()
        merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        if None in merged or merged != sorted(merged) or min(merged, default=256) < 256:
            return None
        import tiktoken

        special = {t["content"] for t in spec.get("added_tokens") or ()}
        ranks = {bytes(signs[c] for c in token): i for token, i in vocab.items() if token not in special}
        return tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _one(self, text: str) -> bytes:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
            except (ValueError, RuntimeError):  # its split gives up on some very long runs
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._one(t) for t in texts]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
