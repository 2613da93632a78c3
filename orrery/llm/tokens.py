"""Encoding with a public tokenizer, each distinct stretch of text once per worker.

Ids of a text are the ids of its stretches, one after another, because the vocabularies cut a text at
certain places whatever stands around them. Stretches are encoded by the tokenizers library in joined
calls, kept in a bounded cache, and their ids joined as bytes. Where the cuts aren't certain, texts go
to the library whole.

A vocabulary that drops white space cuts at any of it. A byte-level one cuts before a single space or
line feed between two characters that are no white space.
"""

from __future__ import annotations

import os
from itertools import islice

import numpy as np
import tokenizers

from orrery.llm.common import claim

#: Stretches that a worker keeps, about 170 bytes each. Beyond it the later half goes: what came early comes often.
REMEMBERED = 1_500_000
#: Stretches that are encoded as one text.
GROUP = 50
_MARK = "\x1c"
os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
#: White space other than space and line feed, and what Python takes for white space and others don't.
_RARE = [chr(i) for i in range(0x3001) if (chr(i).isspace() or chr(i) == _MARK) and chr(i) not in " \n"]
_UNSURE = [_MARK, "\x1d", "\x1e", "\x1f"]


class Encoder:
    """ids(texts) gives the ids of each text as bytes, two each (little-endian): the vocabularies have fewer than 65,536."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit two bytes")
        encode = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.drops_space = encode("a b\nc") == encode("a") + encode("b") + encode("c")
        # Where the vocabulary's normal form of ASCII words is their lower case, that is cheaper to make here.
        self.plain = None
        if self.drops_space and encode("Ab cD") == encode("ab cd"):
            self.plain = tokenizers.Tokenizer.from_file(path)
            self.plain.encode_special_tokens = True
            self.plain.normalizer = None
        self.cache: dict[str, bytes] = {}
        self.mark = encode(" " + _MARK)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def stretches(self, text: str) -> list[str] | None:
        """The stretches of text; in a byte-level vocabulary one that doesn't start with a line feed
        stands for itself after a space, and the text's first after none. None: encode it whole."""
        if self.drops_space:
            return None if any(c in text for c in _UNSURE) else text.split()
        if not text or "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n":
            return None
        if any(c in text for c in _RARE):
            return None
        return text.replace("\n", " \n").split(" ")

    def _learn(self, new: list[str]) -> None:
        """The ids of each stretch, from calls on groups of them with marks between."""
        if self.plain is None:
            self._learn_by(self.tokenizer, new, new)
        else:
            ascii_ = [s for s in new if s.isascii()]
            self._learn_by(self.plain, ascii_, [s.lower() for s in ascii_])
            other = [s for s in new if not s.isascii()]
            self._learn_by(self.tokenizer, other, other)

    def _learn_by(self, tokenizer: tokenizers.Tokenizer, new: list[str], forms: list[str]) -> None:
        end, k = self.mark[-1], len(self.mark)
        lead, between = ("", " " + _MARK + " ") if self.drops_space else (" ", " " + _MARK)
        forms = [s if s[:1] == "\n" else lead + s for s in forms]
        groups = [between.join(forms[i : i + GROUP]) + " " + _MARK for i in range(0, len(forms), GROUP)]
        for i, found in enumerate(tokenizer.encode_batch_fast(groups, add_special_tokens=False)):
            part = new[i * GROUP : (i + 1) * GROUP]
            ids = np.array(found.ids, "<u2")
            ends = np.flatnonzero(ids == end)
            if len(ends) != len(part):  # the mark's id stands in a stretch
                self.cache.update((s, self.whole(f)) for s, f in zip(part, forms[i * GROUP :]))
                continue
            raw, last = ids.tobytes(), 0
            for s, e in zip(part, (2 * (ends + 1)).tolist()):
                self.cache[s] = raw[last : e - 2 * k]
                last = e

    def ids(self, texts: list[str]) -> list[bytes]:
        cut = [self.stretches(t) for t in texts]
        cache = self.cache
        if len(cache) > self.remembered:
            for s in list(islice(cache, self.remembered // 2, None)):
                del cache[s]
        get, skip = cache.get, 0 if self.drops_space else 1
        found, missing, new = [], [], {}
        for c in cut:
            f = None if c is None else list(map(get, c[skip:] if skip else c))
            gone = None
            if f is not None and None in f:
                gone = [s for s, x in zip(c[skip:] if skip else c, f) if x is None]
                new.update(dict.fromkeys(gone))
            found.append(f)
            missing.append(gone)
        if new:
            self._learn(list(new))
        out = []
        for t, c, f, gone in zip(texts, cut, found, missing):
            if f is None:
                out.append(self.whole(t))
                continue
            if gone:
                learned = map(cache.__getitem__, gone)
                f = [next(learned) if x is None else x for x in f]
            ids = b"".join(f)
            out.append(self.whole(c[0]) + ids if skip else ids)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(name_or_path: str, remembered: int = REMEMBERED) -> Encoder:
    """The worker's encoder. A bare file name is looked up among the public tokenizers installed where the worker runs."""
    if name_or_path not in _ENCODERS:
        path = name_or_path
        if "/" not in path:
            import public_tokenizers

            path = str(public_tokenizers.path(name_or_path))
        _ENCODERS[name_or_path] = Encoder(path)
    found = _ENCODERS[name_or_path]
    found.remembered = remembered
    claim(f"tokens of {name_or_path}", found.cache)
    return found
