"""Token ids of a byte-level BPE file, the same as the ``tokenizers`` library gives.

When the file is a plain byte-level BPE whose ids follow its merge order, the ids come
from ``tiktoken`` with the ranks read out of that file (several times faster, equal ids);
any other file is run by ``tokenizers`` itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

_PLAIN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_chars() -> dict[str, int]:
    """The usual printable stand-ins of byte-level BPE: printable Latin-1 stays, the rest moves to 256 and up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(spec: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    model = spec["model"]
    pre = spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE" and not model.get("byte_fallback") and not model.get("dropout")
        and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        and not model.get("ignore_merges")
        and spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    )
    if not plain:
        return None
    special = {}
    for t in spec.get("added_tokens", []):
        if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized"):
            return None
        special[t["content"]] = t["id"]
    chars = _byte_chars()
    ranks = {}
    for token, i in model["vocab"].items():
        if token in special:
            continue
        if any(c not in chars for c in token):
            return None
        ranks[bytes(chars[c] for c in token)] = i
    last = -1
    for m in model["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        made = model["vocab"].get(a + b, -1)
        if made <= last:
            return None
        last = made
    return ranks, special


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a text to its list of ids (no special tokens are added; their strings in a text are found)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    found = _ranks(spec)
    if found is None:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        return lambda text: tok.encode(text, add_special_tokens=False).ids
    import tiktoken

    enc = tiktoken.Encoding("file", pat_str=_PLAIN, mergeable_ranks=found[0], special_tokens=found[1])
    marks = tuple(found[1])

    def ids(text: str) -> list[int]:
        if any(m in text for m in marks):
            return enc.encode(text, allowed_special="all")
        return enc.encode_ordinary(text)

    return ids


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
