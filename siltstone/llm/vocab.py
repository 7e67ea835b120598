"""Word-level access to public vocabulary files, shared by the token operators.

A text splits at ASCII white space without changing its tokens, so each distinct
word is segmented once a block and ids return to their places by position.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import regex

#: Parts of the pattern above that end with letters but start with a mark.
CONTRACTIONS = {b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d"}
#: The longest word that the array form merges; longer ones take the prefix table.
LONGEST = 40
#: The pattern that the vocabulary file splits words with.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below this code point, composition never changes a text and lower case is one character for one.
PLAIN_BELOW = 0x180
#: Words kept with their ids between blocks of one Python worker.
KEPT_WORDS = 120_000


def default_path(name: str) -> str:
    """Where the installed vocabulary package keeps the file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordVocabulary:
    """A vocabulary file with word-end symbols, as arrays for merging many words at once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers

        self.library, self.nfc, self.nfd = Tokenizer.from_file(path), normalizers.NFC(), normalizers.NFD()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.specials = spec["model"], [t["content"] for t in spec["added_tokens"]]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        base = {b: c for c, b in letters.items()}
        self.single = np.array([vocab[base[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([vocab[base[b] + end] for b in range(256)], dtype=np.int64)
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.merge = {int(k): (r, int(m)) for k, r, m in zip(self.keys, self.rank, self.made, strict=True)}
        as_bytes = lambda s: bytes(letters[c] for c in s)
        #: bytes of a token without word end, bytes of a token with it
        self.inner = {as_bytes(s): i for s, i in vocab.items() if not s.endswith(end)}
        self.ending = {as_bytes(s.removesuffix(end)): i for s, i in vocab.items() if s.endswith(end)}
        self.bytes_of = {i: (b, False) for b, i in self.inner.items()} | {i: (b, True) for b, i in self.ending.items()}
        self.pattern = regex.compile(SPLIT)
        self.odd = regex.compile(f"[^\\x00-{chr(PLAIN_BELOW - 1)}]|[İ\\x1c-\\x1f\\x85\\xa0]|" + "|".join(map(regex.escape, self.specials)))
        self.special = regex.compile("|".join(map(regex.escape, self.specials)) or "(?!)")
        self.lowers: dict[str, str] = {}
        self.kinds: dict[str, str] = {}
        self.wholes: dict[bytes, int] = {}
        self.known: dict[str, np.ndarray] = {}
        self.counted: dict[str, np.ndarray] = {}
        self.fits: dict[int, bool] = {}

    def pretokens(self, word: str) -> list[bytes] | None:
        """The parts whose symbols may merge; None where normalisation can reach over characters."""
        try:  # most words are letters of the first 256 characters, maybe with one mark behind
            word.encode("latin-1")
            if word.isalpha():
                return [word.lower().encode()]
            if word[-1] in ",.!?;:" and word[:-1].isalpha():
                return [word[:-1].lower().encode(), word[-1].encode()]
        except UnicodeEncodeError:
            pass
        if self.odd.search(word):
            return None
        return [p.encode() for p in self.pattern.findall(word.lower())]

    def merged(self, parts: list[bytes]) -> list[np.ndarray]:
        """Token ids of each part: all parts of one length merge together, lowest rank and leftmost first."""
        out: list = [None] * len(parts)
        lengths = np.array([len(p) for p in parts])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            if n > LONGEST:
                for i in at:
                    out[i] = np.array(self.merged_one(parts[i]), dtype=np.int64)
                continue
            raw = np.frombuffer(b"".join(parts[i] for i in at), dtype=np.uint8).reshape(len(at), n)
            ids = self.single[raw]
            ids[:, -1] = self.final[raw[:, -1]]
            never = np.int64(1 << 40)
            ranks = np.full((len(at), max(n - 1, 1)), never)
            if n > 1:
                ranks = self.ranks(ids[:, :-1], ids[:, 1:])
            while len(at):
                best = ranks.argmin(axis=1)
                lowest = ranks[np.arange(len(at)), best]
                done = lowest >= never
                if done.any():
                    for i, row in zip(at[done], ids[done], strict=True):
                        out[i] = row
                    left = ~done
                    at, ids, ranks, best, lowest = at[left], ids[left], ranks[left], best[left], lowest[left]
                    if not len(at):
                        break
                # all rows here have the same number of symbols, since each round merges one pair in each
                rows = np.arange(len(at))
                ids[rows, best] = self.made_by_rank[lowest]
                width = ids.shape[1] - 1
                cols = np.arange(width)
                ids = np.take_along_axis(ids, cols + (cols > best[:, None]), axis=1)
                if width == 1:
                    ranks = np.full((len(at), 1), never)
                    continue
                cols = np.arange(width - 1)
                ranks = np.take_along_axis(ranks, cols + (cols >= best[:, None]), axis=1)
                has = best > 0
                if has.any():
                    r, b = rows[has], best[has]
                    ranks[r, b - 1] = self.ranks(ids[r, b - 1], ids[r, b])
                has = best < width - 1
                if has.any():
                    r, b = rows[has], best[has]
                    ranks[r, b] = self.ranks(ids[r, b], ids[r, b + 1])
        return out

    @property
    def made_by_rank(self) -> np.ndarray:
        if not hasattr(self, "_made_by_rank"):
            self._made_by_rank = np.empty(len(self.made), dtype=np.int64)
            self._made_by_rank[self.rank] = self.made
        return self._made_by_rank

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, or a number above all ranks."""
        key = (a << 20) | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], np.int64(1 << 40))

    def merged_one(self, part: bytes) -> list[int]:
        """Token ids of one long part, by the prefix table."""
        return self.tokens_before(part)

    def word_ids(self, words: list[str], times: np.ndarray | None = None) -> list[np.ndarray]:
        """Token ids of each word; words found more than once in a block are remembered for later ones."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known = self.known
        out = [known.get(w) for w in words]
        at = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(at, self.new_ids([words[i] for i in at]), strict=True):
            out[i] = x
            if times is not None and times[i] > 1:
                known[words[i]] = x
        return out

    def new_ids(self, new: list[str]) -> list[np.ndarray]:
        """Token ids of words that aren't remembered."""
        parts: dict[bytes, int] = {}
        plans: list = []
        odd = []
        for w in new:
            p = self.pretokens(w)
            if p is None:
                odd.append(w)
            plans.append(p if p is None else [parts.setdefault(x, len(parts)) for x in p])
        ids = self.merged(list(parts)) if parts else []
        found = dict(zip(odd, (e.ids for e in self.library.encode_batch(odd, add_special_tokens=False)), strict=True)) if odd else {}
        none = np.empty(0, dtype=np.int64)
        out = []
        for w, plan in zip(new, plans, strict=True):
            if plan is None:
                out.append(np.array(found[w], dtype=np.int64))
            elif len(plan) == 1:
                out.append(ids[plan[0]])
            else:
                out.append(np.concatenate([ids[i] for i in plan]) if plan else none)
        return out

    # ---- prefix dynamic programming ----

    def fit(self, a: int, b: int) -> bool:
        """Whether the joined symbols of two tokens (a < 0: of b alone) segment into exactly these tokens."""
        (x, _), (y, ends) = self.bytes_of[a] if a >= 0 else (b"", False), self.bytes_of[b]
        symbols = [int(self.single[c]) for c in x + y]
        if ends:
            symbols[-1] = int(self.final[y[-1]])
        if len(self.fits) > 1_500_000:
            self.fits.clear()
        got = self.fits[(a + 1) << 20 | b] = self.segmented(symbols) == ([a, b] if a >= 0 else [b])
        return got

    def segmented(self, symbols: list[int]) -> list[int]:
        """Merges of a short symbol list."""
        merge = self.merge
        while len(symbols) > 1:
            best = None
            for i in range(len(symbols) - 1):
                m = merge.get(symbols[i] << 20 | symbols[i + 1])
                if m and (best is None or m[0] < best[0]):
                    best = (m[0], i, m[1])
            if best is None:
                break
            symbols[best[1] : best[1] + 2] = [best[2]]
        return symbols

    def backwards(self) -> dict:
        """The tokens by their bytes from last to first: nested tables, with token ids at 256 (no word end) and 257."""
        if not hasattr(self, "_backwards"):
            self._backwards: dict = {}
            for tokens, mark in ((self.inner, 256), (self.ending, 257)):
                for b, i in tokens.items():
                    node = self._backwards
                    for c in reversed(b):
                        node = node.setdefault(c, {})
                    node[mark] = i
        return self._backwards

    def prefix_tables(self, parts: list[bytes]):
        """For each part, in sorted order: (part, last, count, last_end, count_end) over its prefixes.

        ``last[j]`` and ``count[j]`` hold the last token and the number of tokens of
        the first j bytes without a word end, the other two those with one. A
        segmentation less its last token is the segmentation of what is left, so each
        prefix takes one step: the only token that ends there and fits the last token
        of the prefix before it. Sorted parts share the steps of common prefixes. The
        lists are reused; a caller copies what it keeps.
        """
        last, count, last_end, count_end = [-1], [0], [-1], [0]
        before = b""
        for part in sorted(parts):
            n, j = len(part), 0
            for j in range(min(n, len(before)) + 1):  # noqa: B007
                if j == n or j == len(before) or part[j] != before[j]:
                    break
            for table in (last, count, last_end, count_end):
                del table[j + 1 :]
            before = part
            self.extend(part, j, last, count, last_end, count_end)
            yield part, last, count, last_end, count_end

    def extend(self, part: bytes | bytearray, done: int, last: list, count: list, last_end: list, count_end: list) -> None:
        """The steps of all prefixes of a part that are longer than its first ``done`` bytes, added to the lists."""
        root, fits, fit = self.backwards(), self.fits, self.fit
        for j in range(done + 1, len(part) + 1):
            node, i, inner, ending = root, j, None, None
            while i:
                i -= 1
                node = node.get(part[i])
                if node is None:
                    break
                if inner is None and (t := node.get(256)) is not None:
                    f = fits.get((last[i] + 1) << 20 | t)
                    if fit(last[i], t) if f is None else f:
                        inner = t
                        inner_count = count[i] + 1
                        if ending is not None:
                            break
                if ending is None and (t := node.get(257)) is not None:
                    f = fits.get((last[i] + 1) << 20 | t)
                    if fit(last[i], t) if f is None else f:
                        ending = t
                        ending_count = count[i] + 1
                        if inner is not None:
                            break
            last.append(inner)
            count.append(inner_count)
            last_end.append(ending)
            count_end.append(ending_count)

    def tokens_before(self, part: bytes) -> list[int]:
        """The ids of a whole part, read back from its prefix table."""
        _, last, _, last_end, _ = next(self.prefix_tables([part]))
        at, out = len(part), []
        t = last_end[at]
        while at:
            out.append(t)
            at -= len(self.bytes_of[t][0])
            t = last[at]
        return out[::-1]

    def prefix_counts(self, words: list[str], times: np.ndarray | None = None) -> list[np.ndarray]:
        """For each word, the tokens of its first k bytes, k = 1 to all; within a character, those before it."""
        if len(self.counted) > KEPT_WORDS:
            self.counted.clear()
        counted = self.counted
        out = [counted.get(w) for w in words]
        at = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(at, self.new_counts([words[i] for i in at]), strict=True):
            out[i] = x
            if times is not None and times[i] > 1:
                counted[words[i]] = x
        return out

    def new_counts(self, new: list[str]) -> list[np.ndarray]:
        """Prefix counts of words that aren't remembered."""
        plans = [self.pretokens(w) for w in new]
        parts = {p for plan in plans if plan for p in plan} | {b"'"}
        parts |= {p[1:2] for p in parts if p in CONTRACTIONS}
        tables = {part: np.array(count_end, dtype=np.int32) for part, _, _, _, count_end in self.prefix_tables(list(parts))}
        for part in CONTRACTIONS & tables.keys():  # cut short, these fall into a mark and a letter
            if len(part) > 2:
                tables[part] = np.array([0, tables[b"'"][1], tables[b"'"][1] + tables[part[1:2]][1], tables[part][3]], dtype=np.int32)
        result = []
        for w, plan in zip(new, plans, strict=True):
            if plan is None:
                result.append(self.counts_of_odd(w))
            elif len(plan) == 1:
                result.append(tables[plan[0]][1:])
            else:
                base, out = 0, []
                for p in plan:
                    out.append(tables[p][1:] + base)
                    base += int(tables[p][-1])
                result.append(np.concatenate(out))
        return result

    # ---- words whose normalisation can reach over characters ----

    def counts_of_odd(self, word: str) -> np.ndarray:
        """Prefix counts of a word with composition, wider lower case or special tokens, in one walk over it."""
        out, base, at = np.empty(len(word.encode()), dtype=np.int32), 0, 0
        found = [0]
        for m in self.special.finditer(word):
            # until its last character, a special token is plain text
            counts = self.walk(word[at : m.end() - 1])
            found += [base + n for n in counts[1:]]
            base += counts[m.start() - at] + 1
            found.append(base)
            at = m.end()
        found += [base + n for n in self.walk(word[at:])[1:]]
        byte = 0
        for k, c in enumerate(word):
            n = utf8_length(c)
            out[byte : byte + n - 1] = found[k]
            out[byte + n - 1] = found[k + 1]
            byte += n
        return out

    def walk(self, text: str) -> list[int]:
        """Tokens of the first k characters of a text without special tokens, k = 0 to all.

        Composition never reaches over a character that starts a cluster. So a prefix
        is the normalised text of the clusters before and that of a beginning of the
        next one; the latter is taken back and put anew only where a further character
        changes it.
        """
        opens, state, found = self.opens, Parts(self), [0]
        k = 0
        while k < len(text):
            end = k + 1
            while end < len(text) and not opens(text[end]):
                end += 1
            begin, now = None, ""
            if end > k + 1:
                begin = state.mark()
            for c in text[k:end]:
                new = now + c if appends(now, c) else self.composed(now + c)
                if not new.startswith(now):
                    state.back(begin)
                    now = ""
                for x in new[len(now) :]:
                    for y in self.lowered(x):
                        state.push(y)
                now = new
                found.append(state.total())
            k = end
        return found

    def composed(self, text: str) -> str:
        """The composed form, as the library has it."""
        return self.nfc.normalize_str(text)

    def lowered(self, c: str) -> str:
        """A character of a composed text as the library's normaliser leaves it."""
        got = self.lowers.get(c)
        if got is None:
            got = self.lowers[c] = self.library.normalizer.normalize_str(c)
        return got

    def opens(self, c: str) -> bool:
        """Whether no composition or reordering joins the character to what comes before it."""
        return c < "\u0300" or c not in self.joining()

    def joining(self) -> frozenset[str]:
        """Marks, second parts of compositions, and what begins with one of these when taken apart; all that this Python doesn't know."""
        if not hasattr(self, "_joining"):
            every = [chr(i) for i in range(0x80, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
            known = [c for c in every if unicodedata.category(c) != "Cn"]
            out = {c for c in every if unicodedata.combining(c)} | (set(every) - set(known))
            taken = self.nfd.normalize_str("\n".join(known)).split("\n")
            out.update(x for t in taken for x in t[1:])
            out.update([c for c, t in zip(known, taken, strict=True) if t[0] in out])
            self._joining = frozenset(out)
        return self._joining

    def kind(self, c: str) -> str:
        """Letter, number, space or other, as the library's pattern sees a character."""
        got = self.kinds.get(c)
        if got is None:
            cut = self.library.pre_tokenizer.pre_tokenize_str
            alone = cut("a" + c)
            if len(alone) == 1:
                got = "L" if alone[0][1][1] == 2 else "S"
            else:
                got = "N" if len(cut(c + c)) == 2 else "O"
            self.kinds[c] = got
        return got

    def whole(self, part: bytes) -> int:
        """Tokens of a whole short part."""
        got = self.wholes.get(part)
        if got is None:
            got = self.wholes[part] = len(self.tokens_before(part))
        return got


def utf8_length(c: str) -> int:
    """The bytes of a character."""
    return 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4


def appends(text: str, c: str) -> bool:
    """Whether a mark surely stays as it is behind a composed text: one of its class there keeps it from composing."""
    n = unicodedata.combining(c)
    return bool(text) and n > 0 and unicodedata.combining(text[-1]) == n and not unicodedata.decomposition(c)


class Parts:
    """The parts of a normalised text that grows by characters and can be set back, with its tokens."""

    def __init__(self, vocabulary: WordVocabulary):
        self.v, self.kind, self.base, self.quote = vocabulary, "S", 0, None
        self.open_part()

    def open_part(self) -> None:
        self.part, self.tables = bytearray(), ([-1], [0], [-1], [0])

    def mark(self) -> tuple:
        return self.kind, self.base, self.quote, self.part, self.tables, len(self.part)

    def back(self, to: tuple) -> None:
        """To a mark set before; later marks are void."""
        self.kind, self.base, self.quote, self.part, self.tables, n = to
        del self.part[n:]
        for table in self.tables:
            del table[n + 1 :]

    def total(self) -> int:
        return self.base + self.tables[3][-1]

    def close(self) -> None:
        """What comes next begins a part."""
        self.base, self.kind = self.total(), "S"
        self.open_part()

    def grow(self, c: str) -> None:
        done = len(self.part)
        self.part += c.encode()
        self.v.extend(self.part, done, *self.tables)

    def push(self, c: str) -> None:
        """One more character."""
        kind, quote = self.v.kind(c), self.quote
        self.quote = None
        if quote is not None:  # (tokens before, text) of a mark that began a part, and maybe a letter
            text = quote[1] + c.encode() if kind == "L" else b""
            if text in CONTRACTIONS:
                self.base = quote[0] + self.v.whole(text)
                self.kind = "S"
                self.open_part()
                return
            if len(text) == 2 and text in (b"'r", b"'v", b"'l"):
                self.quote = (quote[0], text)
        if kind != self.kind or kind == "N":
            self.close()
            if kind == "S":
                return
            self.kind = kind
            if c == "'":
                self.quote = (self.base, b"'")
        elif kind == "S":
            return
        self.grow(c)


@lru_cache(maxsize=2)
def word_vocabulary(path: str) -> WordVocabulary:
    """One table for each file and Python worker."""
    return WordVocabulary(path)
