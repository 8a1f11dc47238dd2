r"""Cuts texts where a byte-level tokenizer always cuts, so that encoded pieces can be kept and reused.

The pre-tokenizer's pattern lets a space only begin a token or stand in a run of white space. A space
after a character that isn't white space therefore always begins a new token, and no pattern looks back
past it: the ids of a text are the ids of its pieces, one after the other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

CUT = re.compile(r"(?<=\S)(?= )")
KEEP_CHARS = 48


def byte_level(path: str) -> dict:
    """The parsed tokenizer file; an error if its ids may not be those of its pieces."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre, added = spec.get("model") or {}, spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    bytewise = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and (spec.get("decoder") or {}).get("type") == "ByteLevel"
    exact = not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")) and not any(" " in t["content"] for t in added)
    if spec.get("normalizer") or not (plain and bytewise and exact):
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
    return spec


class PieceCache:
    """Ids of texts as bytes (little-endian int32). ``encode_pieces`` encodes a list of pieces.

    ``limit`` bounds the pieces kept; beyond it the cache starts anew. Long pieces are never kept.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], list[bytes]], limit: int = 2_000_000) -> None:
        self.encode_pieces, self.limit = encode_pieces, limit
        self.kept: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.kept) > self.limit:
            self.kept.clear()
        kept, new, rows = self.kept, set(), []
        for text in texts:
            words = text.split(" ")
            head = words.pop(0)
            codes = list(map(kept.get, words))
            lost = [i for i, c in enumerate(codes) if c is None] if None in codes else ()
            new.update([words[i] for i in lost])
            rows.append((head, words, codes, lost))
        odd = {w for w in new if not w or w[-1].isspace()}
        heads: set[str] = set()
        whole: dict[int, list[str]] = {}
        for i, (head, words, _, lost) in enumerate(rows):
            if (odd and any(words[k] in odd for k in lost)) or head[-1:].isspace():
                whole[i] = CUT.split(texts[i])
                heads.update(whole[i])
            elif head:
                heads.add(head)
        new -= odd
        found, others = list(new), list(heads)
        codes = self.encode_pieces([" " + w for w in found] + others)
        kept.update(zip(found, codes))
        own = dict(zip(others, codes[len(found) :]))
        own[""] = b""
        out = []
        for i, (head, words, codes, lost) in enumerate(rows):
            if i in whole:
                out.append(b"".join([own[x] for x in whole[i]]))
            else:
                for k in lost:
                    codes[k] = kept[words[k]]
                out.append(own[head] + b"".join(codes))
        for w in found:
            if len(w) > KEEP_CHARS:
                del kept[w]
        return out
