"""Token counts from a prefix dynamic program over byte-pair encoding.

A byte-pair encoding is the sequence whose neighbouring tokens are all *compatible*: merging the two of
them from scratch gives the same two back. So the encoding of every prefix of a word is found left to
right: its last token is the one token that ends there and is compatible with the last token of the
prefix before it, and its count is that prefix's count plus one. One pass stores the exact token count of
every prefix, so "how many tokens are in the first k characters" and "which prefix fits a budget" are
answered from the stored counts, without encoding again.

The pass runs once for each distinct word a worker meets; the first ``MAX_WORDS`` words keep their count, so
memory is bounded whatever the corpus holds, and later words are counted each time; a text is split at white space, where no token crosses.
Special strings inside a text count as the library counts them by default: one token each.

Defined results: NULL is the empty text, with no tokens; repeated rows give equal rows; NULL ids are kept;
empty tables give empty results; other columns are ignored. Nothing is shuffled or truncated.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
MAX_WORDS = 600_000

#: White space as tokenizers' patterns read it (Unicode White_Space; str.split also takes \x1c-\x1f).
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Marks a word's end in the automaton; it is no character of the byte alphabet.
_CLOSE = "\0"
_CONTROL = ("\x1c", "\x1d", "\x1e", "\x1f")


def split_words(text: str) -> list[str]:
    if any(c in text for c in _CONTROL):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: visible Latin-1 characters for
    themselves, the others for 256 upwards in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class PrefixCounter:
    """Exact counts at every prefix, for a ``tokenizers`` file of word-end BPE over bytes."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.end = model["model"]["end_of_word_suffix"] or ""
        special = [t["content"] for t in model["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        ids = model["model"]["vocab"]
        self.final = {t[: len(t) - len(self.end)]: i for t, i in ids.items() if t.endswith(self.end)}
        self.ends = ahocorasick.Automaton()  # the tokens that end at each position, those of word ends after _CLOSE
        for t, i in ids.items():
            key = t.removesuffix(self.end) + _CLOSE if t.endswith(self.end) else t
            self.ends.add_word(key, (len(key), i))
        self.ends.make_automaton()
        self.merged: dict[int, tuple[int, int]] = {}  # pair -> its rank and the token it makes
        self.halves: dict[int, tuple[int, int, int]] = {}  # token -> its halves and rank
        for rank, m in enumerate(model["model"]["merges"]):
            x, y = m.split(" ") if isinstance(m, str) else m
            i, j, t = ids[x], ids[y], ids[x + y]
            self.merged[i << 20 | j] = rank, t
            self.halves[t] = i, j, rank
        self.symbols = {i: [ids[c] for c in t.removesuffix(self.end)][:-1] + [ids[t.removesuffix(self.end)[-1] + self.end * t.endswith(self.end)]] for t, i in ids.items() if i in self.halves}
        self.alphabet = byte_alphabet()
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.words: dict[str, int] = {}

    def _own(self, t: int) -> bool:
        """Whether a token is the encoding of its own text (plain merging of its few symbols)."""
        known = self.whole.get(t)
        if known is None:
            s = list(self.symbols.get(t, [t]))
            while len(s) > 1:
                ranks = [self.merged.get(x << 20 | y, (1 << 60, 0)) for x, y in zip(s, s[1:], strict=False)]
                rank, made = min(ranks)
                if rank == 1 << 60:
                    break
                k = next(i for i, r in enumerate(ranks) if r[0] == rank)
                s[k : k + 2] = [made]
            known = self.whole[t] = s == [t]
        return known

    def _spine(self, t: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at one side of a token while it is built, with the rank that ends each."""
        out = [(t, 1 << 60)]
        while t in self.halves:
            rank = self.halves[t][2]
            t = self.halves[t][side]
            out.append((t, rank))
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether token ``a`` (or nothing, -1) followed by ``b`` is how their joined text is encoded: both
        encode themselves, and no merge across the border comes before the merges that use its two sides."""
        key = (a + 1) << 20 | b
        known = self.pairs.get(key)
        if known is None:
            known = self._own(b)
            if known and a >= 0:
                right = self._spine(b, 0)
                for x, x_ends in self._spine(a, 1):
                    for y, y_ends in right:
                        m = self.merged.get(x << 20 | y)
                        if m and m[0] < x_ends and m[0] <= y_ends:
                            known = False
            if len(self.pairs) < 4 * MAX_WORDS:
                self.pairs[key] = known
        return known

    def table(self, s: str) -> tuple[list[int], list[int]]:
        """For every prefix of a piece (in the byte alphabet), as the inside of a word: the last token of
        its encoding and its count; one entry more is for the piece as a whole word."""
        n = len(s)
        last, count, pairs = [-2] * (n + 2), [0] * (n + 2), self.pairs.get
        last[0] = -1
        for at, (size, t) in self.ends.iter(s + _CLOSE):
            if last[at + 1] == -2:
                j = at + 1 - size
                a = last[j]
                ok = pairs((a + 1) << 20 | t)
                if ok or (ok is None and self.compatible(a, t)):
                    last[at + 1], count[at + 1] = t, count[j] + 1
        return last, count

    def closed(self, s: str, k: int, last: list[int], count: list[int]) -> int:
        """Count of ``s[:k]`` as a whole word, one step from the stored table."""
        for j in range(k):
            t = self.final.get(s[j:k])
            if t is not None and self.compatible(last[j], t):
                return count[j] + 1
        return 0

    def piece(self, s: str) -> int:
        return self.table(s)[1][-1]

    def _total(self, word: str) -> int:
        """Tokens of a text without white space."""
        head = word.rstrip(".,")
        if head.isalpha() and "\u03a3" not in head and unicodedata.is_normalized("NFC", head):  # capital sigma lowers by context
            low = head.lower()
            if low.isalpha():
                if len(head) != len(word):
                    return self.total(low) + self.total(word[len(head) :])
                return self.piece(low) if low.isascii() else self.piece("".join([self.alphabet[b] for b in low.encode()]))
        normal = self.library.normalizer.normalize_str(word)
        return sum(self.piece(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal))

    def total(self, word: str) -> int:
        known = self.words.get(word)
        if known is None:
            known = self._total(word)
            if len(self.words) < MAX_WORDS:
                self.words[word] = known
        return known

    def prefixes(self, word: str) -> list[int]:
        """Count at every character prefix of a text without white space; entry k is for ``word[:k]``.

        Read off the stored piece counts where a prefix is normalised and split like the whole, which
        holds for a run of letters; other words (contractions, combining marks) go prefix by prefix."""
        if word.isalpha() and unicodedata.is_normalized("NFC", word):
            low = self.library.normalizer.normalize_str(word)
            pieces = self.library.pre_tokenizer.pre_tokenize_str(low)
            if len(low) == len(word) and len(pieces) == 1:
                at, k = [0], 0
                for c in low:
                    k += len(c.encode())
                    at.append(k)
                s = pieces[0][0]
                last, count = self.table(s)
                return [self.closed(s, k, last, count) if k else 0 for k in at]
        return [self._total(word[:k]) if k else 0 for k in range(len(word) + 1)]

    def parts(self, text: str) -> list[str]:
        """The text at its special strings; these are every second part."""
        return self.special.split(text) if self.special and "<|" in text else [text]

    def count(self, text: str) -> int:
        parts = self.parts(text)
        get, total = self.words.get, self.total
        n = len(parts) // 2
        for part in parts[::2]:
            for w in split_words(part):
                k = get(w)
                n += total(w) if k is None else k
        return n

    def budget_chars(self, text: str, budget: int) -> int:
        """Length of a longest prefix (it ends at or inside a word) that stays within the budget: the last
        whole word that fits by running counts, then that word's stored prefix counts."""
        n = at = 0
        for k, part in enumerate(self.parts(text)):
            if k % 2:
                if n + 1 > budget:
                    return at
                n, at = n + 1, at + len(part)
                continue
            pos = 0
            for w in split_words(part):
                start = part.index(w, pos)
                c = self.total(w)
                if n + c > budget:
                    inside = self.prefixes(w)
                    best = max((i for i in range(len(w) + 1) if n + inside[i] <= budget), default=0)
                    return at + start + best
                n, pos = n + c, start + len(w)
            at += len(part)
        return at


@lru_cache(maxsize=4)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_tokens, over_limit, limit_chars``; the last is the length in
    characters of the longest prefix within ``limit`` tokens, read from the stored counts."""

    def run(batches):
        counter = _counter(tokenizer_path(tokenizer))
        for b in batches:
            n, cut = [], []
            for text in b.column(1).to_pylist():
                k = counter.count(text)
                n.append(k)
                cut.append(len(text) if k <= limit else counter.budget_chars(text, limit))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(cut, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "limit_chars"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = out.schema["doc_id"].dataType.simpleString()
    out = out.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, limit_chars long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "limit_chars")


def prefix_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, word_ends, counts``: the character at which each word ends and the tokens up to
    there, from which any budget question is a binary search."""

    def run(batches):
        counter = _counter(tokenizer_path(tokenizer))
        for b in batches:
            ends, counts = [], []
            for text in b.column(1).to_pylist():
                e, c, at, n = [], [], 0, 0
                for k, part in enumerate(counter.parts(text)):
                    if k % 2:
                        n += 1
                        e.append(at + len(part))
                        c.append(n)
                    else:
                        pos = 0
                        for w in split_words(part):
                            pos = part.index(w, pos) + len(w)
                            n += counter.total(w)
                            e.append(at + pos)
                            c.append(n)
                    at += len(part)
                ends.append(e)
                counts.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "word_ends", "counts"])

    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return out.mapInArrow(run, f"doc_id {out.schema['doc_id'].dataType.simpleString()}, word_ends array<long>, counts array<long>")
