"""Byte-pair encoding from the states of text prefixes.

The encoding of a word's prefix is that of a shorter prefix plus one last token: of the tokens that end the prefix,
exactly one goes with the last token of what stands before it. So one last token for each prefix holds the encodings
of all prefixes. ``encode_words`` visits distinct words in sorted order, which is the depth-first order of their trie
(neighbours share the path of their common prefix), and computes the states of shared prefixes once.
"""

from __future__ import annotations

import bisect
import contextlib
import functools
import gc
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate

from tokenizers import Tokenizer

#: White space as the tokenizers library's patterns have it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Below this code point letters and numbers are the same in all Unicode versions; other text is split by the library.
PLAIN = 0x250
KEY = 1 << 20


def _kind(first: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] == first)


L, N = _kind("L"), _kind("N")
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Words of the byte-level vocabularies, with their leading space, and of the vocabulary with word ends.
BYTE_WORDS = re.compile(f"{CONTRACTIONS}| ?[{L}]+| ?[{N}]+| ?[^{SPACE}{L}{N}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
END_WORDS = re.compile(f"{CONTRACTIONS}|[{L}]+|[{N}]|[^{SPACE}{L}{N}]+")
#: A run of white space and the run of other characters after it: nothing outside changes how a library splits it.
CHUNKS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
SOLID = re.compile(f"[^{SPACE}]+")
CONTRACTION = re.compile(CONTRACTIONS)


def byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


LETTERS = byte_letters()


def to_letters(s: str) -> str:
    return "".join([LETTERS[b] for b in s.encode("utf-8", "surrogatepass")])


class Vocabulary:
    """A BPE vocabulary of the tokenizers library's JSON format, whose base symbols are all bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.tokens |= {i: t for t, i in self.specials.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        n = max(self.tokens) + 1
        self.rank, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b, t = self.ids[a], self.ids[b], self.ids[a + b]
            self.merges[a * KEY + b] = rank
            self.rank[t], self.left[t], self.right[t] = rank, a, b
        sound: dict[int, bool] = {}
        for t in sorted(self.ids.values(), key=self.rank.__getitem__):
            a, b = self.left[t], self.right[t]
            sound[t] = a < 0 or sound[a] and sound[b] and self._apart(a, b, self.rank[t])
        inner = {s: t for s, t in self.ids.items() if sound[t] and not (self.end and s.endswith(self.end))}
        final = {s.removesuffix(self.end): t for s, t in self.ids.items() if sound[t] and s.endswith(self.end)}
        self.inner, self.final = inner, final
        self.inner_longest, self.final_longest = map(self._longest, (inner, final))
        self.met: dict[int, bool] = {}

    @staticmethod
    def _longest(tokens: Iterable[str]) -> dict[str, int]:
        """The length of the longest token for each three last characters (two or one for shorter tokens)."""
        out: dict[str, int] = {}
        for s in tokens:
            for end in (s[-3:], s[-2:], s[-1:]):
                if len(end) < 3 and len(s) > len(end):  # a shorter end stands for the tokens that have no more
                    continue
                if out.get(end, 0) < len(s):
                    out[end] = len(s)
        return out

    def _apart(self, x: int, y: int, until: int = 1 << 60) -> bool:
        """Whether no merge before rank `until` joins tokens x and y where they touch.

        Goes back in time along the parts at the border: the younger part is undone, and a merge of two neighbours
        happens if its rank comes before both are merged otherwise (of equal ranks, the left one comes first).
        """
        rank, merges = self.rank, self.merges
        x_ends = y_ends = until
        while True:
            m = merges.get(x * KEY + y)
            if m is not None and m < x_ends and m <= y_ends and m < until:
                return False
            if rank[x] > rank[y]:
                x_ends, x = rank[x], self.right[x]
            elif rank[y] >= 0:
                y_ends, y = rank[y], self.left[y]
            else:
                return True

    def encode_words(self, words: list[str], counts: bool = False) -> Iterator[tuple[str, list]]:
        """For sorted distinct words in byte letters: the ids or, with counts, the token count of every prefix."""
        inner, final, end, met, apart = self.inner, self.final, self.end, self.met, self._apart
        longest, final_longest = self.inner_longest, self.final_longest
        last, begin, total, before = [0], [0], [0], ""
        for w in words:
            if len(met) > 1_500_000:
                met.clear()
            n = len(w)
            most = min(len(before), n, len(last) - 1)
            k = 0
            while k < most and w[k] == before[k]:
                k += 1
            del last[k + 1 :], begin[k + 1 :], total[k + 1 :]
            before = w
            for i in range(k + 1, n if end else n + 1):
                j = i - (longest.get(w[i - 3 : i], 2) if i > 2 else i)
                if j < 0:
                    j = 0
                while True:
                    t = inner.get(w[j:i])
                    if t is not None:
                        if not j:
                            break
                        ok = met.get(key := last[j] * KEY + t)
                        if ok is None:
                            ok = met[key] = apart(last[j], t)
                        if ok:
                            break
                    j += 1
                last.append(t)
                begin.append(j)
                total.append(total[j] + 1)
            if counts:
                yield w, total[: n + 1]
                continue
            ids, i = [], n
            if end:
                j = n - (final_longest.get(w[-3:], 2) if n > 2 else n)
                if j < 0:
                    j = 0
                while True:
                    t = final.get(w[j:])
                    if t is not None:
                        if not j:
                            break
                        ok = met.get(key := last[j] * KEY + t)
                        if ok is None:
                            ok = met[key] = apart(last[j], t)
                        if ok:
                            break
                    j += 1
                ids.append(t)
                i = j
            while i:
                ids.append(last[i])
                i = begin[i]
            yield w, ids[::-1]

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at special strings, as the library does by default; True marks a special."""
        if self.special is None or not any(s in text for s in self.specials):
            yield text, False
            return
        for i, s in enumerate(self.special.split(text)):
            if s:
                yield s, bool(i % 2)

    def spans(self, chunk: str) -> list[str]:
        """A chunk's words in plain characters."""
        if max(chunk) < chr(PLAIN):
            return (END_WORDS if self.end else BYTE_WORDS).findall(chunk)
        return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def normal(self, chunk: str) -> str:
        if self.library.normalizer is None:
            return chunk
        return chunk.lower() if chunk.isascii() else self.library.normalizer.normalize_str(chunk)

    def letters(self, chunk: str) -> list[str]:
        return [w if w.isascii() and w.isprintable() and " " not in w else to_letters(w) for w in self.spans(self.normal(chunk))]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: byte letters turned back where the vocabulary names that decoder, else tokens with spaces between."""
        if not self.byte_decoder:
            return " ".join(map(self.tokens.__getitem__, ids))
        return self.library.decode(list(ids), skip_special_tokens=False)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once a worker."""
    return Vocabulary(path)


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary: $TOKENIZERS_DIR, or the installed package of vocabulary files."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory(dict):
    """A bounded dictionary of two generations: what wasn't asked for while `limit` new items came goes."""

    def __init__(self, limit: int):
        self.limit, self.old = limit, {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys not held; those of the older generation come back into this one. Old items go only here."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        out, old = [], self.old
        for k in keys:
            if k not in self:
                v = old.get(k)
                if v is None:
                    out.append(k)
                else:
                    self[k] = v
        return out


@contextlib.contextmanager
def no_cycles():
    """The cycle collector walks all that the memories hold, again and again; nothing here makes cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class ChunkEncoder:
    """Ids and decoded tokens of texts, for vocabularies whose decoder puts spaces between tokens; bounded memories of words and chunks, filled by the trie over each batch's new words."""

    def __init__(self, vocab: Vocabulary, limit: int = 200_000):
        if vocab.byte_decoder:
            raise ValueError("pieces of a byte decoder's text don't join; use PrefixCounter or token_ids for byte-level vocabularies")
        self.vocab, self.known, self.words = vocab, Memory(limit), Memory(limit)

    def learn(self, chunks: set[str]) -> None:
        letters, decode, words, known = self.vocab.letters, self.vocab.decode, self.words, self.known
        split = {c: letters(c) for c in known.missing(chunks)}
        for w, ids in self.vocab.encode_words(sorted(words.missing({w for found in split.values() for w in found}))):
            words[w] = (len(ids), " ".join(map(str, ids)), decode(ids))
        for c, found in split.items():
            if len(found) == 1:
                known[c] = words[found[0]]
            else:
                parts = [words[w] for w in found]
                known[c] = (sum([x[0] for x in parts]), " ".join([x[1] for x in parts]), " ".join([x[2] for x in parts]))

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: token count, decimal ids with one space between, decoded text."""
        vocab, cut = self.vocab, []
        for t in texts:
            cut.append([(s, None) if special else (s, SOLID.findall(s)) for s, special in vocab.segments(t)])
        self.learn({c for parts in cut for _, chunks in parts if chunks for c in chunks})
        known = self.known.__getitem__
        for parts in cut:
            found = []
            for s, chunks in parts:
                found.extend([(1, str(vocab.specials[s]), s)] if chunks is None else map(known, chunks))
            if any(not x[0] for x in found):  # a chunk that the normaliser leaves nothing of
                found = [x for x in found if x[0]]
            counts, ids, tokens = zip(*found) if found else ((), (), ())
            yield sum(counts), " ".join(ids), " ".join(tokens)


class PrefixCounter:
    """Exact token counts at every prefix of a text, in a byte-level vocabulary without normalisation.

    The tables: for every distinct word the count at each of its prefixes, for every chunk its count. A text's prefixes
    are sums of them, so questions on cuts and budgets need no further encoding. Both tables are bounded.
    """

    def __init__(self, vocab: Vocabulary, limit: int = 200_000):
        if vocab.end or vocab.library.normalizer is not None:
            raise ValueError("prefix counts need a byte-level vocabulary without word ends and normaliser")
        self.vocab, self.known, self.words = vocab, Memory(limit), Memory(limit)

    def learn(self, chunks: set[str]) -> None:
        new = self.known.missing(chunks)
        spans, words = self.vocab.spans, self.words
        split = {c: spans(c) for c in new}
        self._learn_words({w for found in split.values() for w in found})
        for c, found in split.items():
            self.known[c] = words[found[0]][-1] if len(found) == 1 else sum([words[w][-1] for w in found])

    def _learn_words(self, words: set[str]) -> None:
        new = self.words.missing(words)
        letters = {w if w.isascii() and w.isprintable() and w[0] != " " else to_letters(w): w for w in new}
        for x, counts in self.vocab.encode_words(sorted(letters), counts=True):
            w = letters[x]
            counts = counts if len(x) == len(w) else _by_character(w, counts)
            self.words[w] = bytes(counts) if counts[-1] < 250 else array("I", counts)

    def total(self, texts: list[str], budget: int | None = None) -> list[int] | list[tuple[int, int]]:
        """Tokens of each text; with a budget, also the characters of its longest prefix of at most so many tokens."""
        cut = [[(1, ()) if special else (0, CHUNKS.findall(s)) for s, special in self.vocab.segments(t)] for t in texts]
        self.learn({c for parts in cut for _, chunks in parts for c in chunks})
        get, out = self.known.__getitem__, []
        for text, parts in zip(texts, cut, strict=True):
            if len(parts) == 1 and not parts[0][0]:
                counts = [*map(get, chunks := parts[0][1])]
                n = sum(counts)
                if budget is None:
                    out.append(n)
                elif n <= budget:
                    out.append((n, len(text)))
                else:  # the last chunk that begins below the budget is the last that can fit in part
                    i = bisect.bisect_left(ends := [*accumulate(counts)], budget)
                    at, base = sum(map(len, chunks[:i])), ends[i] - counts[i]
                    inside = self._plain(chunks[i], base) if ends[i] > budget else array("I", [budget] * len(chunks[i]))
                    out.append((n, at + next((p for p in range(len(inside), 0, -1) if inside[p - 1] <= budget), 0)))
                continue
            n = sum([k + sum(map(get, chunks)) for k, chunks in parts])
            out.append(n if budget is None else (n, len(text) if n <= budget else self.fitting(text, budget)))
        return out

    def prefixes(self, text: str) -> array:
        """The count at each prefix of the text, in characters: item p is the count of text[:p]."""
        out, before, base = array("I", [0]), "", 0
        for s, special in self.vocab.segments(text):
            if special:  # as long as it is cut, its beginning is ordinary text
                out.extend(self._plain(before + s[:-1], base)[len(before) :])
                before, base = "", base + (self._plain(before, 0)[-1] if before else 0) + 1
                out.append(base)
            else:
                before = s
                out.extend(self._plain(s, base))
        return out

    def _plain(self, s: str, base: int) -> array:
        """Counts at the ends of all characters of a text without specials, from `base` on."""
        out, words = array("I"), self.words
        for c in CHUNKS.findall(s):
            start, at = len(out), base
            found = self.vocab.spans(c)
            self._learn_words({*found, run} if (run := c[: len(c) - len(c.lstrip(SPACES))]) else {*found})
            for w in found:
                counts = words[w]
                if len(w) > 1 and CONTRACTION.fullmatch(w):  # its own prefixes aren't contractions
                    counts = [*range(len(w)), counts[-1]]
                out.extend([at + x for x in counts[1:]])
                at += counts[-1]
            for i in range(1, len(run) + 1 if len(run) > 1 else 0):  # a prefix that ends in white space ends with one word of it
                out[start + i - 1] = base + words[run][i]
            base = at
        return out

    def fitting(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most `budget` tokens."""
        counts = self.prefixes(text)
        return next(p for p in range(len(counts) - 1, -1, -1) if counts[p] <= budget)


SPACES = "".join(chr(c) for c in range(0x3001) if re.match(f"[{SPACE}]", chr(c)))


def _by_character(w: str, counts: list[int]) -> list[int]:
    """Counts at byte prefixes, at those that end a character."""
    if len(counts) == len(w) + 1:
        return counts
    out, at = [0], 0
    for ch in w:
        at += len(ch.encode("utf-8", "surrogatepass"))
        out.append(counts[at])
    return out
