"""Encoding whole texts with public tokenizers, with a memo of pieces.

The vocabularies split a text into pieces that are merged independently, so a
piece's ids never change with its neighbours.  Pieces recur; each is encoded
by the tokenizers library once and looked up afterwards.  A text in which the
cut at spaces could differ from the tokenizer's own is encoded as a whole, and
so is one that holds the string of a special token.
"""

from __future__ import annotations

import functools
import itertools
import operator
import os
from array import array

import numpy as np

#: Pieces remembered by a worker; beyond it only those used since the last turn stay.
MEMO = 800_000
#: Words encoded as one text.
TOGETHER = 500


class Encoder:
    """``encoder(text)`` gives the ids, ``end_id`` appended, as bytes of ``dtype``.

    The ids are those of the library's plain call: the string of a special
    token in a text is that token, unless ``specials_as_text`` is set.
    """

    def __init__(self, path: str, end_id: int, specials_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.specials = [] if specials_as_text else sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.end = array(self.code, [end_id]).tobytes()
        # With a normalizer that folds white space, a space never enters a piece.
        self.spaced = self.tokenizer.normalizer is None
        if self.spaced and hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # what it would keep, the memo has
        # Tokens that begin (with a space in front) or end (marked so) a word.
        self.edge = np.zeros(1 << 16 if self.dtype.itemsize == 2 else self.tokenizer.get_vocab_size(), bool)
        self.edge[[i for t, i in self.tokenizer.get_vocab().items() if (t.startswith("\u0120") if self.spaced else t.endswith("</w>"))]] = True
        # ASCII capitals that the normalizer lowers anyway would only fill the memo.
        self.lowers = not self.spaced and self.tokenizer.normalizer.normalize_str("AMZ") == "amz"
        self.marks = dict(zip(["", ".", ",", "\n"], self.whole(["", ".", ",", "\n"])))
        self.memo: dict = {}
        self.older: dict = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], before: str) -> list[bytes]:
        """Ids of words of letters only, ``before`` in front of each, encoded as one text that is cut again by word."""
        led = before == " " and self.spaced
        if before == "\n" and self.spaced:
            got = self.tokenizer.encode(before.join(words), add_special_tokens=False)
            ids = np.array(got.ids, self.dtype)
            cuts = np.flatnonzero(np.diff(np.array(got.word_ids, np.int64))) + 1
            step = 2  # a line feed is a piece of its own
        else:
            text = before + before.join(words) if led else before.join(words)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(self.edge[ids[1:]]) + 1 if led else np.flatnonzero(self.edge[ids[:-1]]) + 1
            step = 1
        if len(cuts) + 1 != step * (len(words) - 1) + 1:  # letters that a normalizer takes apart
            return self.whole([" " + w if led else w for w in words])
        raw, size = ids.tobytes(), self.dtype.itemsize
        ends = [0, *(cuts * size).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(ends[::step], ends[1::step])]

    def _learn(self, new: set) -> None:
        """Put pieces into the memo; None for one that may reach over its end."""
        memo, older = self.memo, self.older
        known = new & older.keys()
        memo.update((p, older[p]) for p in known)
        pieces = list(new - known)
        if not pieces:
            return
        texts = pieces if self.spaced else b" ".join(pieces).decode().split(" ")
        # Letters only: cut where the tokenizer cuts.  Most pieces are of this kind.
        plain = list(map(str.isalpha, texts))
        if not self.spaced:
            plain = list(map(operator.and_, plain, map(str.isalpha, map(str.lower, texts))))
        words, keys = list(itertools.compress(texts, plain)), list(itertools.compress(pieces, plain))
        for at in range(0, len(words), TOGETHER):
            memo.update(zip(keys[at : at + TOGETHER], self._words(words[at : at + TOGETHER], " ")))
        inner: list[tuple] = []
        starts: list[tuple] = []
        others: list[tuple] = []
        odd = list(map(operator.not_, plain))
        for p, text in zip(itertools.compress(pieces, odd), itertools.compress(texts, odd)):
            mark = text[-1:] if text[-1:] in (".", ",") else ""
            stem = text[:-1] if mark else text
            # Letters and one mark.
            if stem.isalpha() and (self.spaced or stem.lower().isalpha()):
                inner.append((p, stem, mark))
            elif not self.spaced:
                others.append((p, text))
            elif stem[:1] == "\n" and stem[1:].isalpha():
                starts.append((p, stem[1:], mark))
            elif text in ("", "\n") or len(text.split()) > 1 or text.strip() != text.removeprefix("\n"):
                memo[p] = None
            else:
                others.append((p, text if text[0] == "\n" else f" {text}"))
        memo.update(zip((p for p, _ in others), self.whole([t for _, t in others])))
        for found, before, head in ((inner, " ", b""), (starts, "\n", self.marks["\n"])):
            stems = list({s for _, s, _ in found})
            ids: dict = {}
            for at in range(0, len(stems), TOGETHER):
                some = stems[at : at + TOGETHER]
                ids.update(zip(some, self._words(some, before)))
            for p, stem, mark in found:
                memo[p] = head + ids[stem] + self.marks[mark]

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, ``end_id`` appended."""
        if any(s in t for s in self.specials for t in texts):
            odd = {i for i, t in enumerate(texts) if any(s in t for s in self.specials)}
            alone = iter(self.whole([texts[i] for i in sorted(odd)]))
            rest = iter(self.many([t for i, t in enumerate(texts) if i not in odd]))
            return [next(alone) + self.end if i in odd else next(rest) for i in range(len(texts))]
        if len(self.memo) >= MEMO:
            self.older, self.memo = self.memo, {}
        if self.spaced:
            # What starts with a line feed had no space before it; any other piece but the first had one.
            cuts = [t.replace("\n", " \n").split(" ") for t in texts]
            first = self.whole([c.pop(0) for c in cuts])
        else:
            cuts = [t.encode().lower().split() if self.lowers else t.encode().split() for t in texts]
            first = [b""] * len(texts)
        self._learn(set().union(*cuts) - self.memo.keys())
        ids = self.memo.__getitem__
        out: list = []
        for i, c in enumerate(cuts):
            try:
                out.append(b"".join([first[i], *map(ids, c), self.end]))
            except TypeError:
                out.append(self.whole([texts[i]])[0] + self.end)
        return out


@functools.cache
def encoder(path: str, end_id: int, specials_as_text: bool = False) -> Encoder:
    """One encoder per worker."""
    return Encoder(path, end_id, specials_as_text)
