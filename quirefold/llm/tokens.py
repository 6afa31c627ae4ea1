"""Word-level token ids by the ``tokenizers`` library, for whole Arrow columns of texts.

The vocabulary drops white space and never merges across it, so a text's ids are the ids of its blank-separated
chunks in order; special tokens that stand in a text are recognised as the library does, inside chunks, too. Texts are
taken in blocks of bounded size. Arrow splits a block and numbers its different chunks; a chunk of Latin letters with
marks behind it is a lower-case word and its marks, as the vocabulary's own normaliser and splitter have it. Only
different words, marks and other chunks are looked up in the worker's caches, and what is missing there is encoded
together: words as one text, since each is one pre-token, whose last id is one of those that end a word. The ids of the
block are then gathered by number.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quirefold.llm.common import holding

#: Token that ends each document.
END = 2
#: Longest chunk that is kept for other blocks.
_KEPT = 64


class ChunkCache(dict):
    """chunk -> little-endian unsigned 32-bit ids; two generations, so that common chunks survive and memory is bounded.

    ``learn(chunks)`` gives the ids of a list of chunks.
    """

    def __init__(self, learn, limit: int):
        super().__init__()
        self.learn, self.limit, self.old = learn, limit, {}

    def of(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk; chunks are different."""
        missing = [c for c in chunks if c not in self]
        if len(self) + len(missing) > self.limit:
            self.old = {k: v for k, v in self.items() if len(k) <= _KEPT}
            self.clear()
            missing = chunks
        old = self.old
        self.update((c, old[c]) for c in missing if c in old)
        fresh = [c for c in missing if c not in old]
        if fresh:
            self.update(zip(fresh, self.learn(fresh)))
        return list(map(self.__getitem__, chunks))


def gathered(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the entries ``which`` of ``flat``, one behind another, their sizes); ``sizes`` are those of all entries."""
    starts, n = np.cumsum(sizes) - sizes, sizes[which]
    upto = np.cumsum(n) - n
    return flat[np.repeat(starts[which] - upto, n) + np.arange(n.sum())], n


class WordTokenizer:
    """``encoded(texts)``: ids of whole texts, without special tokens around them."""

    _PLAIN = r"^(?P<word>[A-Za-zªµºÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?#*$%&\"()]*)$"

    def __init__(self, path: str, limit: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        # lower-case Latin words need neither the normaliser nor the splitter, which take half of the time
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[k for token, k in names.items() if token.endswith("</w>")]] = True
        self.words, self.others = ChunkCache(self._words, limit), ChunkCache(self._each, limit // 8)

    def _each(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):  # some letter isn't a pre-token's: ask for each
            return self._each(words)
        raw, at, out = ids.tobytes(), 0, []
        for stop in (stops * 4).tolist():
            out.append(raw[at:stop])
            at = stop
        return out

    def encoded(self, texts: pa.Array, end: int | None = None, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, ends: text k has ids[ends[k]:ends[k + 1]]); null counts as empty.

        ``end`` is put behind each text. A block has about ``block`` bytes, or one text if that is longer.
        """
        texts = texts.fill_null("")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("i8"))
        found, counts, at = [], [np.zeros(1, "i8")], 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + block, "right")))
            ids, n = self._block(texts.slice(at, stop - at))
            if end is not None:
                last = np.cumsum(n + 1) - 1
                all_ids = np.full(len(ids) + len(n), end, "<u4")
                own = np.ones(len(all_ids), bool)
                own[last] = False
                all_ids[own] = ids
                ids, n = all_ids, n + 1
            found.append(ids)
            counts.append(n)
            at = stop
        return (np.concatenate(found) if found else np.array([], "<u4")), np.cumsum(np.concatenate(counts))

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        numbered = split.flatten().dictionary_encode()
        chunks = numbered.dictionary
        parted = pc.extract_regex(chunks, pattern=self._PLAIN)
        odd = parted.is_null()
        words = pc.utf8_lower(parted.field("word")).dictionary_encode()
        others = pc.if_else(odd, chunks, parted.field("marks")).dictionary_encode()
        own = [*self.words.of(words.dictionary.to_pylist()), *self.others.of(others.dictionary.to_pylist())]
        sizes = np.fromiter(map(len, own), "i8", len(own)) // 4
        # a chunk is a word (none for others: an entry without ids) and what follows it
        parts = np.empty((len(chunks), 2), "i8")
        parts[:, 0] = pc.if_else(odd, len(own), words.indices).to_numpy(zero_copy_only=False)
        parts[:, 1] = others.indices.to_numpy() + len(words.dictionary)
        flat, n = gathered(np.frombuffer(b"".join(own), "<u4"), np.append(sizes, 0), parts.reshape(-1))
        ids, n = gathered(flat, n.reshape(-1, 2).sum(axis=1), numbered.indices.to_numpy())
        upto = np.concatenate([np.zeros(1, "i8"), np.cumsum(n)])
        ends = split.offsets.to_numpy()
        return ids, np.diff(upto[ends - ends[0]])

    def ids(self, text: str | None) -> bytes:
        return self.encoded(pa.array([text], pa.string()))[0].tobytes()


_OPEN: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker and file."""
    holding("words", _OPEN.clear)
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]
