"""Token ids of whole texts by the public vocabularies."""

from __future__ import annotations

import base64
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Where the vocabulary files are; a parameter of every operator that needs one.
WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.tiktoken"
MULTI_VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Exact ids of a tokenizer that lower-cases, drops white space and marks the last id of every word.

    Texts are cut at ASCII white space in Arrow and each distinct chunk is encoded once. A chunk of Latin letters is one
    word, so many of them are encoded as one text and told apart by the ids that end words; one comma or full stop after
    them is a word of its own. All other chunks are encoded between special tokens.
    """

    KEEP = 400_000
    #: Words that are encoded at once; the library's results take far more memory than the ids.
    AT_ONCE = 8192
    STOPS = (".", ",")

    def __init__(self, path: str, separator: str = "<|startoftext|>", ending: str = "</w>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and threads' memory adds up
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator, self.separator_id = separator, self.tokenizer.token_to_id(separator)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(ending)]] = True
        self.ranked = self._ranked(path, vocabulary, ending)
        self.stops = {c: np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, np.uint32) for c in self.STOPS}
        assert all(len(x) == 1 for x in self.stops.values())
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    @staticmethod
    def _ranked(path: str, vocabulary: dict[str, int], ending: str):
        """The same merges for words of Latin letters in a faster library, or None where ids do not follow the merges.

        There, the pair whose result has the lowest id is merged first. That is the order of the merges if ids follow
        them, and a word's end is a byte of its own, which no such word holds: it joins the last letter before all else,
        because ids of single bytes with an end come before those of the merges.
        """
        import tiktoken

        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        results = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in merges]
        if [vocabulary.get(r) for r in results] != list(range(512, 512 + len(results))):
            return None
        # printable stand-ins of bytes, as byte-level vocabularies have them: printable bytes for themselves, the rest from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {}
        for token, i in vocabulary.items():
            word = token.removesuffix(ending)
            if i < 512 + len(results):
                ranks[bytes(byte_of[c] for c in word) + (b"\n" if word != token else b"")] = i
        return tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _latin(chunk: str) -> bool:
        """Composed Latin letters, of which none turns into several or into a mark when lower-cased."""
        return chunk.isascii() or (max(chunk) < "\u0180" and "\u0130" not in chunk and "\u0149" not in chunk)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of words of Latin letters."""
        if self.ranked is not None:
            ids = self.ranked.encode_to_numpy("\n".join(words).lower() + "\n", disallowed_special=()) if words else np.zeros(0, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            assert len(ends) == len(words)
            return ids, ends
        blocks = (" ".join(words[i : i + self.AT_ONCE]) for i in range(0, len(words), self.AT_ONCE))
        ids = [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32) for x in blocks]
        ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        assert len(ends) == len(words)
        return ids, ends

    def _learn(self, chunks: list[str]) -> None:
        plain = [c for c in chunks if c.isalpha() and self._latin(c)]
        stopped = [c for c in chunks if c[-1] in self.STOPS and c[:-1].isalpha() and self._latin(c)]
        seen = {*plain, *stopped}
        odd = [c for c in chunks if c not in seen]
        words = list(dict.fromkeys([*plain, *(c[:-1] for c in stopped)]))
        ids, ends = self._words(words)
        place = {w: i for i, w in enumerate(words)}
        begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        # a stopped chunk's ids are its word's with the stop's id after them
        which = np.array([place[c] for c in plain] + [place[c[:-1]] for c in stopped], np.int64)
        extra = np.array([0] * len(plain) + [1] * len(stopped), np.int64)
        size = ends[which] - begins[which] if len(which) else which
        total = size + extra
        stop = np.cumsum(total)
        flat = np.zeros(stop[-1] if len(stop) else 0, np.uint32)
        one = np.repeat(np.arange(len(which)), size)
        within = np.arange(len(one)) - np.repeat(np.cumsum(size) - size, size)
        flat[(stop - total)[one] + within] = ids[begins[which][one] + within] if len(one) else 0
        if stopped:
            flat[stop[len(plain) :] - 1] = [self.stops[c[-1]][0] for c in stopped]
        parts, counts = [self.ids, flat], [total]
        simple = [c for c in odd if "<|" not in c]
        odd = [c for c in odd if "<|" in c]
        for i in range(0, len(simple), 512):
            ids = np.array(self.tokenizer.encode(self.separator.join(simple[i : i + 512]), add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(ids == self.separator_id)
            counts.append(np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1)
            parts.append(np.delete(ids, cut))
        for c in odd:
            ids = np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, np.uint32)
            counts.append(np.array([len(ids)]))
            parts.append(ids)
        first = len(self.known)
        self.known.update(zip([*plain, *stopped, *simple, *odd], range(first, first + len(chunks)), strict=True))
        self.ids = np.concatenate(parts)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(counts))])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): document i has ids[bounds[i]:bounds[i + 1]]; null reads as empty."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        flat = lists.flatten()
        flat = pc.if_else(pc.string_is_ascii(flat), pc.ascii_lower(flat), flat) if not pc.any(pc.match_substring(texts, "<|")).as_py() else flat
        coded = flat.dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        if len(self.known) > self.KEEP:
            self._forget()
        if new := [c for c in chunks if c not in self.known]:
            full = [c for c in new if c]
            if len(full) < len(new):
                self.known[""] = len(self.known)
                self.at = np.append(self.at, self.at[-1])
            if full:
                self._learn(full)
        where = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        codes = where[coded.indices.to_numpy(zero_copy_only=False)] if len(chunks) else np.zeros(0, np.int64)
        start, size = self.at[codes], self.at[codes + 1] - self.at[codes]
        done = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(start - done[:-1], size) + np.arange(done[-1])]
        per_text = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
        return ids, done[per_text]


def byte_counter(path: str):
    """A function from text to its number of byte-level BPE tokens."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))
