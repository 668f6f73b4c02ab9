"""BPE encoding by speculation and verification, and decoding.

1. Speculate: every distinct word is cut by greedy longest match against the
   vocabulary, all words of a batch stepping through one trie together.
2. Verify: a token sequence is the merge order's own result exactly when
   each adjacent pair of its tokens is what merging the two joined strings
   would give. All adjacent pairs of the batch are checked at once.
3. Repair: only words with a failing pair go through exact merging.

Text is cut at the white space that the tokenizer drops, so that equal chunks are
normalised and cut into words once; a bounded memory of chunks is kept for
each Python worker.
"""

from __future__ import annotations

import hashlib
import gc
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text
from .packing import byte_alphabet

#: Distinct chunks that a worker remembers before it starts afresh.
MEMORY = 400_000
#: Characters at which chunks are cut where str.split() can't be used, as it takes four control
#: characters for white space which the tokenizer keeps; other white space is left to the tokenizer.
_CUT = re.compile(r"[ \n\r\t]+")
_KEPT = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Chunks of composed Latin letters and then ASCII marks other than the apostrophe: at most
#: two words, which no normalisation but lower case changes.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")
_END = 256  # symbol of a byte that ends its word: the byte + 256


class SpeculativeBpe:
    """Encoder and decoder for a tokenizers file with BPE and a word-end suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.tokenizer = Tokenizer.from_file(path)
        self.exact = self.tokenizer.model
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.id_text = [str(i) for i in range(max(self.strings) + 1)]
        self.token_text = [self.strings.get(i, "") for i in range(max(self.strings) + 1)]
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.alphabet = byte_alphabet()
        self.letters = {b: c for c, b in self.alphabet.items()}
        self.simple = self._probe()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): r for r, (a, b) in reversed([*enumerate(pairs)])}
        self._arrays(pairs)
        self.words: dict[str, tuple[str, str, int]] = {}
        self.chunks: dict[str, tuple[str, str, int]] = {}
        self.speculated = self.repaired = 0

    def _probe(self) -> bool:
        """Whether the file's normaliser and word rule treat simple chunks as _SIMPLE does."""
        if not self.tokenizer.normalizer or not self.tokenizer.pre_tokenizer:
            return False
        marks = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
        letters = "".join(c for c in map(chr, range(0x41, 0x100)) if re.match("[A-Za-zÀ-ÖØ-öø-ÿ]", c))
        words = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(letters + marks))]
        return words == ["".join(self.letters[b] for b in letters.lower().encode()), marks]

    def _symbols(self, token: str) -> list[int]:
        ends = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
        out = [self.alphabet[c] for c in (token.removesuffix(self.suffix) if ends else token)]
        if ends:
            out[-1] += _END
        return out

    def _arrays(self, pairs: list[tuple[str, str]]) -> None:
        """The trie and the merges as sorted keys, for searching in bulk."""
        size = max(self.vocab.values()) + 1
        never = np.iinfo(np.int64).max
        self.base_ids = np.full(2 * _END, -1, np.int64)
        steps: dict[int, int] = {}
        final = [-1]
        for token, i in self.vocab.items():
            if token in self.special:
                continue
            at = 0
            for s in self._symbols(token):
                at = steps.setdefault(at << 9 | s, len(final))
                if at == len(final):
                    final.append(-1)
            final[at] = i
        for s in range(2 * _END):
            if s in steps:
                self.base_ids[s] = final[steps[s]]
        keys = np.fromiter(steps, np.int64, len(steps))
        order = keys.argsort()
        self.step_keys, self.step_to = keys[order], np.fromiter(steps.values(), np.int64, len(steps))[order]
        self.final = np.array(final)
        # merge r joins left[id], right[id]; a token's birth is the rank of the merge that makes it, -1 for a symbol
        self.left, self.right, self.birth = (np.full(size, v, np.int64) for v in (-1, -1, -1))
        for r, (a, b) in enumerate(pairs):
            made = self.vocab[a + b]
            if self.left[made] < 0:
                self.left[made], self.right[made], self.birth[made] = self.vocab[a], self.vocab[b], r
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = keys.argsort()
        self.pair_keys, self.pair_rank = keys[order], np.fromiter(self.rank.values(), np.int64, len(keys))[order]
        self.never = never

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], self.never)

    def speculate(self, words: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches: (word of each token, token), in order.

        A word at whose position nothing matches gets the token -1 and ends.
        """
        lengths = np.array([len(w) for w in words])
        flat = np.array([s for w in words for s in w], np.int64)
        ends = lengths.cumsum()
        at = ends - lengths
        live = np.arange(len(words))[lengths > 0]
        out_word, out_token = [], []
        while len(live):
            node, pos = np.zeros(len(live), np.int64), at[live].copy()
            best, best_pos = np.full(len(live), -1, np.int64), pos.copy()
            walk = np.arange(len(live))
            while len(walk):
                key = node[walk] << 9 | flat[pos[walk]]
                k = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
                walk, k = walk[hit := self.step_keys[k] == key], k[hit]
                node[walk] = self.step_to[k]
                pos[walk] += 1
                token = self.final[node[walk]]
                best[walk] = np.where(token >= 0, token, best[walk])
                best_pos[walk] = np.where(token >= 0, pos[walk], best_pos[walk])
                walk = walk[pos[walk] < ends[live[walk]]]
            out_word.append(live)
            out_token.append(best)
            at[live] = best_pos
            live = live[(best >= 0) & (best_pos < ends[live])]
        if not out_word:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, token = np.concatenate(out_word), np.concatenate(out_token)
        order = word.argsort(kind="stable")
        return word[order], token[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joined strings of a and b leaves just a and b.

        Undo the later of the two tokens' last merges, again and again: the pair
        fails as soon as the two inner neighbours would have merged with
        each other before the merge that was undone. On equal rank the left one of two
        merges comes first.
        """
        good = (a >= 0) & (b >= 0)
        live = np.flatnonzero(good)
        x, y = a[live], b[live]
        before = np.full(len(live), self.never)  # the neighbours may merge at this rank or later only
        while len(live):
            r = self._rank_of(x, y)
            clash = r < before
            good[live[clash]] = False
            live, x, y, before = live[~clash], x[~clash], y[~clash], before[~clash]
            bx, by = self.birth[x], self.birth[y]
            more = (bx >= 0) | (by >= 0)
            live, x, y, bx, by = live[more], x[more], y[more], bx[more], by[more]
            undo_x = bx >= by
            # an equal rank: the left part's merge was first, so the middle pair must be strictly earlier to win;
            # against the right part's merge the middle pair, standing further left, wins ties
            before = np.where(undo_x, bx, by + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return good

    def merge(self, word: str) -> list[int]:
        """Exact merging of one word, lowest rank first, by the tokenizer's own routine."""
        return [t.id for t in self.exact.tokenize(word)]

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word, given in the byte alphabet without suffix."""
        symbols = []
        for w in words:
            s = [self.alphabet[c] for c in w]
            if self.suffix and s:
                s[-1] += _END
            symbols.append(s)
        word, token = self.speculate(symbols)
        bad = np.zeros(len(words), bool)
        bad[word[token < 0]] = True
        inner = np.flatnonzero(word[1:] == word[:-1])
        bad[word[inner[~self.compatible(token[inner], token[inner + 1])]]] = True
        cuts = np.searchsorted(word, np.arange(len(words) + 1))
        flat = token.tolist()
        self.speculated += len(words)
        self.repaired += int(bad.sum())
        return [tuple(self.merge(words[i])) if bad[i] else tuple(flat[cuts[i] : cuts[i + 1]]) for i in range(len(words))]

    def _chunk_words(self, chunk: str) -> list[str | int]:
        """Words of a chunk in the byte alphabet; ids for special tokens."""
        if self.simple and (m := _SIMPLE.match(chunk)):
            word, marks = m.groups()
            word = word.lower()
            if not word.isascii():
                word = "".join(map(self.letters.__getitem__, word.encode()))
            return [word, marks] if marks else [word]
        parts = self.at_special.split(chunk) if self.at_special and "<|" in chunk else [chunk]
        out: list[str | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                out += [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks that aren't known yet."""
        collects = gc.isenabled()
        gc.disable()  # a million small tuples without cycles, which it would walk again and again
        try:
            self._learn(chunks)
        finally:
            if collects:
                gc.enable()

    def _learn(self, chunks: set[str]) -> None:
        if len(self.chunks) + len(chunks) > MEMORY:
            self.chunks.clear()
            self.words.clear()
        cut = {c: self._chunk_words(c) for c in chunks if c not in self.chunks}
        words = self.words
        new = list({w for ws in cut.values() for w in ws if w not in words and w.__class__ is str})
        number, string = self.id_text, self.token_text
        for w, ids in zip(new, self.encode_words(new), strict=True):
            words[w] = (" ".join([number[i] for i in ids]), " ".join([string[i] for i in ids]), len(ids))
        chunks = self.chunks
        for c, ws in cut.items():
            found = [words[w] if w.__class__ is str else (str(w), self.strings[w], 1) for w in ws]
            if len(found) == 1:
                chunks[c] = found[0]
            elif len(found) == 2:
                (i, s, m), (j, t, n) = found
                chunks[c] = (f"{i} {j}", f"{s} {t}", m + n)
            else:
                ids, strings, n = zip(*found, strict=True) if found else ((), (), ())
                chunks[c] = (" ".join(ids), " ".join(strings), sum(n))

    def encode(self, text: str) -> list[int]:
        cut = chunks_of(text)
        self.learn(set(cut))
        return [int(i) for c in cut for i in self.chunks[c][0].split()]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by one space, special ones kept: what a
        tokenizer without a decoder gives."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


def chunks_of(text: str) -> list[str]:
    if any(c in text for c in _KEPT):
        return [c for c in _CUT.split(text) if c]
    return text.split()


@cache
def bpe(path: str) -> SpeculativeBpe:
    return SpeculativeBpe(path)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array) and decoded text of every document.

    A null text counts as empty and has no ids; a null id stays null;
    repeated rows are each encoded; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(tokenizer)
        for batch in batches:
            ids = [model.encode(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, schema.types[1]), pa.array([*map(model.decode, ids)])], schema=schema)

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same encoding, as doc_id, n_tokens, ids_sha256, decoded_sha256.

    Chunks of about a million characters are learnt together, so that memory stays bounded
    for long texts and large batches. Nulls, repeats and other columns as in
    encode_documents; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(tokenizer)

        def digest(texts: list[str]) -> list[tuple[int, str, str]]:
            cut = [*map(chunks_of, texts)]
            model.learn(set().union(*cut))
            known = model.chunks
            out = []
            for cs in cut:
                found = [x for c in cs if (x := known[c])[2]]
                out.append((sum(x[2] for x in found), _sha256(" ".join(x[0] for x in found)), _sha256(" ".join(x[1] for x in found))))
            return out

        for batch in batches:
            rows, texts, size = [], [], 0
            for text in batch["text"]:
                texts.append(text.as_py())
                size += len(texts[-1])
                if size > 1_000_000:
                    rows += digest(texts)
                    texts, size = [], 0
            rows += digest(texts)
            if rows:
                columns = [batch["doc_id"], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUT.types[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=_OUT)

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
