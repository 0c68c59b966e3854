"""Exact BPE ids by dynamic programming over prefixes, and their decoding.

A generalised suffix automaton over the vocabulary names, at each place of a word, the tokens that end there. The BPE
result of every prefix ends in exactly one token: the candidate that is compatible with the last token of the prefix
before it. These last tokens are stored, and back-pointers from the end give the ids. Two tokens are
compatible if no merge across their border would have been taken while both sides were being merged; the test undoes
the merges of both sides from the latest to the earliest.

Words are split off as the tokenizer's own normaliser and pattern do (NFC, white space, lower case per character, letters
/ single digits / other marks, byte-level characters, an end-of-word mark), special strings first. Runs between white space
never affect each other, so their results are remembered, within a bound.

Contract: a null text counts as empty (no ids; the digests are those of the empty string). Repeated rows get equal results;
very long texts cost memory in proportion to their own length alone. The vocabulary file is a parameter, read on each worker.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_batches, spread, table

#: White space of Unicode, as the tokenizer's pattern sees it. str.split() also takes these four, which it does not.
_SEPARATORS = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
_ODD = regex.compile("[\x1c-\x1f]")
#: Most runs, and most words, that a worker remembers; about 0.4 kB each.
REMEMBERED = 400_000
_ENDED = "\n"
#: Up to here the character classes are settled, and nothing combines with what stands before.
LATIN = "\u024f"
_LATE = 1 << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def runs(text: str) -> list[str]:
    """The runs of a text between white space."""
    if _ODD.search(text):
        return [x for x in _SEPARATORS.split(text) if x]
    return text.split()


def encoder_pieces(path: str):
    """A function that cuts a run into lower-case pieces by the file's pattern; None for what only the library may cut."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
    special = [t["content"] for t in spec["added_tokens"]]

    def cut(run: str) -> list[str] | None:
        if not run.isascii():
            if max(run) > LATIN:
                return None
            run = unicodedata.normalize("NFC", run)
        if "<" in run and any(x in run for x in special):
            return None
        return pattern.findall(run.lower())

    return cut


class Memo(dict):
    """Remembers what make gives, up to a bound; the frequent keys, which come early, stay."""

    def __init__(self, make, bound: int = REMEMBERED):
        super().__init__()
        self.make, self.bound = make, bound

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.bound:
            self[key] = value
        return value


class SuffixAutomaton:
    """A generalised suffix automaton of many strings. token[s] is the string that is the longest of its state."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.token = [-1], [0], [-1]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.token.append(-1)
        return len(self.link) - 1

    def _split(self, p: int, c: str) -> int:
        """The state of the string of p with c added, made its own if it shares a state with longer ones."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(self.length[p] + 1)
        self.next[own] = dict(self.next[q])
        self.link[own], self.link[q] = self.link[q], own
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = own
            p = self.link[p]
        return own

    def add(self, string: str, token: int) -> None:
        last = 0
        for c in string:
            if c in self.next[last]:
                last = self._split(last, c)
                continue
            made, p = self._state(self.length[last] + 1), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = made
                p = self.link[p]
            if p >= 0:
                self.link[made] = self._split(p, c)
            last = made
        self.token[last] = token

    def finish(self) -> None:
        """ending[s]: the tokens among the proper suffixes that links reach, longest first, with their lengths."""
        self.ending: list[tuple] = [()] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            own = ((self.token[up], self.length[up]),) if self.token[up] >= 0 else ()
            self.ending[s] = own + self.ending[up] if own else self.ending[up]


class Encoder:
    """Ids and decoded strings under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.names = {v: k for k, v in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({v: k for k, v in self.special.items()})
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._pieces = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self._bytes = self.byte_names()
        self.pair_rank: dict[tuple[int, int], int] = {}
        size = max(self.ids.values()) + 1
        self.made, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"]):
            a, b, whole = self.ids[a], self.ids[b], self.ids[a + b]
            if self.made[whole] >= 0 or max(self.made[a], self.made[b]) >= rank:
                raise ValueError("merges must make each token once, from tokens made before")
            self.pair_rank[a, b] = self.made[whole] = rank
            self.left[whole], self.right[whole] = a, b
        self.automaton = SuffixAutomaton()
        sound = [True] * size
        for name, token in sorted(self.ids.items(), key=lambda x: self.made[x[1]]):
            if self.made[token] >= 0:
                a, b = self.left[token], self.right[token]
                sound[token] = sound[a] and sound[b] and self._meets(a, b, self.made[token])
            if sound[token]:
                self.automaton.add(name[: -len(self.end)] + _ENDED if name.endswith(self.end) and name != self.end else name, token)
        self.automaton.finish()
        self._compatible = Memo(lambda key: self._meets(key >> 20, key & (1 << 20) - 1, _LATE), 2_000_000)
        self.words = Memo(lambda piece: self._tokens(piece.encode("utf-8", "replace").decode("latin-1").translate(self._bytes)))
        self._library = Tokenizer.from_file(path)

    @staticmethod
    def byte_names() -> dict[int, str]:
        """The printable character that stands for each byte: itself, or else the next one from 256 on."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def _meets(self, a: int, b: int, until: int) -> bool:
        """False if a merge across the border of a and b is taken before rank until, while both sides are merged."""
        made, pair = self.made, self.pair_rank
        upper_a = upper_b = until
        while True:
            rank = pair.get((a, b))
            if rank is not None and rank < upper_a and (rank <= upper_b if upper_b < until else rank < until):
                return False
            if made[a] > made[b]:
                upper_a, a = made[a], self.right[a]
            elif made[b] >= 0:
                upper_b, b = made[b], self.left[b]
            else:
                return True

    def _tokens(self, word: str) -> tuple[int, ...]:
        """The ids of one piece in byte-level characters: the last token of each prefix, then back from the end."""
        auto, ok = self.automaton, self._compatible
        states, link, length, token, ending = auto.next, auto.link, auto.length, auto.token, auto.ending
        word += _ENDED
        last: list[int] = [-1] * (len(word) + 1)
        size = [0] * (len(word) + 1)
        state = matched = 0
        for at, c in enumerate(word, 1):
            while c not in states[state]:
                if state == 0:
                    raise ValueError(f"the vocabulary lacks the byte {c!r}")
                state = link[state]
                matched = length[state]
            state = states[state][c]
            matched += 1
            if token[state] >= 0 and matched == length[state]:
                candidates = ((token[state], matched), *ending[state])
            else:
                candidates = ending[state]
            for t, n in candidates:
                before = at - n
                if before == 0 or last[before] >= 0 and ok[last[before] << 20 | t]:
                    last[at], size[at] = t, n
                    break
            else:
                if not size[at]:
                    raise ValueError(f"the vocabulary has no token for {word[:at]!r}")
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= size[at]
        return tuple(out[::-1])

    def run(self, text: str) -> list[int]:
        """The ids of one run, or of any text."""
        if self._special is not None and "<" in text and self._special.search(text):
            out, at = [], 0
            for m in self._special.finditer(text):
                out += self._plain(text[at : m.start()]) + [self.special[m.group()]]
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[int]:
        if not text.isascii():
            if max(text) > LATIN:  # which characters are letters there depends on the library's Unicode version
                pieces = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
                return [i for piece, _ in pieces for i in self._tokens(piece)]
            text = unicodedata.normalize("NFC", text)
        words = self.words
        return [i for piece in self._pieces.findall(text.lower()) for i in words[piece]]

    def encode(self, text: str | None) -> list[int]:
        return [i for r in runs(text or "") for i in self.run(r)]

    def decode(self, ids) -> str:
        """The tokens' own strings joined by a space, as the library does for a file without a decoder."""
        return " ".join(map(self.names.__getitem__, ids))


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, over whole texts."""
    path = path or default_vocabulary()

    def apply(batches):
        enc = encoder(path)

        def strings(run: str) -> tuple[str, str, int]:
            ids = enc.run(run)
            return " ".join(map(str, ids)), enc.decode(ids), len(ids)

        memo = Memo(strings)
        look = memo.__getitem__
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for value in batch.column(1):
                found = [x for x in map(look, runs(value.as_py() or "")) if x[2]]
                counts.append(sum([x[2] for x in found]))
                encoded.append(hashlib.sha256(" ".join([x[0] for x in found]).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join([x[1] for x in found]).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), apply, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spread(table(spark, sf_dir, "documents")))
