"""Token ids of whole Arrow columns by a word-level tokenizers file: every different word is encoded once."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# The split pattern of the vocabulary file (fixed value): white space never lies inside a match.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
WORD_END = "</w>"
_JOINED = 5000  # pieces that reach the tokenizer in one string
_TAKEN = 1 << 20  # words whose ids are laid out at once, so that their bytes stay far below 2 GB


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts as tokenizers' `encode(text, add_special_tokens=False)` gives them.

    The vocabulary normalises character by character and then splits at white space, so a text's
    ids are those of its blank-separated words in a row. Words are made unique per batch by Arrow,
    looked up in a bounded cache, and only new ones reach the tokenizer. Plain Latin-1 words go
    there as lower-case pieces in one joined string, whose pieces end where a word-end token stands;
    all other words (and any string on which that count fails) are encoded one by one.
    """

    def __init__(self, path: str, keep: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for pieces that are normalised and split already: the same merges without those steps
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.keep = keep
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat uint32 ids of all texts, and the number of ids of each; null counts as empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        parts = pa.array(self._words(coded.dictionary.to_pylist()), pa.binary())
        # Arrow lays the bytes of the taken words side by side: these are the ids in a row
        pieces = [parts.take(coded.indices.slice(k, _TAKEN)) for k in range(0, len(coded), _TAKEN)]
        flat = [np.frombuffer(p.buffers()[2] or b"", np.uint32) for p in pieces]
        ends = [np.diff(np.frombuffer(p.buffers()[1], np.int32, len(p) + 1)) for p in pieces]
        ids = np.concatenate([f[: int(n.sum()) // 4] for f, n in zip(flat, ends)]) if pieces else np.zeros(0, np.uint32)
        upto = np.concatenate(([0], *ends)).cumsum(dtype=np.int64) // 4
        offsets = split.offsets.to_numpy()
        return ids, np.diff(upto[offsets - offsets[0]])

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {}
        young = self.young
        found = list(map(young.get, words))
        missing = [w for w, ids in zip(words, found) if ids is None]
        if not missing:
            return found
        kept = list(map(self.old.get, missing))
        young.update([(w, ids) for w, ids in zip(missing, kept) if ids is not None])
        new = [w for w, ids in zip(missing, kept) if ids is None]
        if new:
            self._learn(new)
        return list(map(young.__getitem__, words))

    def _learn(self, new: list[str]) -> None:
        if len(self.pieces) > self.keep:
            self.pieces = {}
        whole, tailed, cut = [], [], {}
        for w in new:
            if not (w.isascii() or _latin(w)):
                self.young[w] = self._one(w)
            elif w.isalpha():
                whole.append(w)
            elif "<|" in w:
                self.young[w] = self._one(w)
            elif w[-1:] in ",." and w[:-1].isalpha():
                tailed.append(w)
            else:
                cut[w] = PIECE.findall(w.lower())
        heads, tops = [w[:-1].lower() for w in tailed], [w.lower() for w in whole]
        found = {*tops, *heads, *(w[-1] for w in tailed), *(p for c in cut.values() for p in c)}
        missing = list(found - self.pieces.keys())
        for start in range(0, len(missing), _JOINED):
            self._pieces(missing[start : start + _JOINED])
        known = self.pieces
        self.young.update(zip(whole, map(known.__getitem__, tops)))
        self.young.update({w: known[h] + known[w[-1]] for w, h in zip(tailed, heads)})
        self.young.update({w: b"".join([known[p] for p in c]) for w, c in cut.items()})

    def _pieces(self, pieces: list[str]) -> None:
        joined = self.merges.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0]  # without places in the text
        ids = np.array(joined.ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(pieces):
            raw = ids.tobytes()
            start = 0
            for p, end in zip(pieces, (ends * 4).tolist()):
                self.pieces[p] = raw[start:end]
                start = end
        else:
            for p in pieces:
                self.pieces[p] = self._one(p)

    def _one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()


def _latin(word: str) -> bool:
    try:
        word.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


KEEP_WORDS = 300_000
TEXT_BYTES = 8 << 20  # texts encoded together: the more, the fewer different words a text brings
_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, keep: int = KEEP_WORDS) -> WordEncoder:
    """One per worker process, so that its cache of some `keep` words serves every task of the worker."""
    if (path, keep) not in _ENCODERS:
        _ENCODERS[path, keep] = WordEncoder(path, keep)
    return _ENCODERS[path, keep]
