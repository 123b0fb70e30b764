"""Token ids of whole texts, a batch of texts at a time.

The tokenizer drops white space before it builds tokens, so a text's ids are those of its blank- or
newline-separated words, one after the other. A batch is split into words and reduced to its distinct ones with
Arrow; each worker keeps the ids of words it has seen (bounded; it starts anew when full) and runs the tokenizer
over new ones only. The tokenizer also lower-cases, so A-Z are lowered before words are compared; a batch with
something like a special token is left as it is."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = "<|startoftext|>"
END_ID = 1
LONG = 64
_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


class WordEncoder:
    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        self.limit = limit
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        plain = [w for w in new if len(w) <= LONG and "<|" not in w]
        odd = [w for w in new if len(w) > LONG or "<|" in w]
        learned = dict(zip(odd, (ids.tobytes() for ids in self._encode(odd)), strict=True))
        groups = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        for group, ids in zip(groups, self._encode([SEPARATOR.join(g) for g in groups]), strict=True):
            cuts = np.flatnonzero(ids == self.separator).tolist()
            raw = ids.tobytes()
            starts, ends = [0, *(c + 1 for c in cuts)], [*cuts, len(ids)]
            learned.update({w: raw[4 * a : 4 * b] for w, a, b in zip(group, starts, ends, strict=True)})
        return learned

    def _words(self, words: list[str]) -> list[bytes]:
        codes = list(map(self.known.get, words))
        new = [w for w, code in zip(words, codes, strict=True) if code is None]
        if new:
            learned = self._learn(new)
            codes = [learned[w] if code is None else code for w, code in zip(words, codes, strict=True)]
            short = {w: code for w, code in learned.items() if len(w) <= LONG}
            if len(self.known) + len(short) > self.limit:
                self.known.clear()
            self.known.update(short)
        return codes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and where each text begins (one more entry than texts)."""
        texts = pc.replace_substring(texts.fill_null(""), "\n", " ")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        parts = pc.split_pattern(texts, " ")
        coded = parts.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        codes = self._words(coded.dictionary.to_pylist())
        pool = np.frombuffer(b"".join(codes), "<u4")
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        places = np.cumsum(sizes) - sizes
        length = sizes[which]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = pool[np.repeat(places[which] - ends[:-1], length) + np.arange(ends[-1])]
        bounds = parts.offsets.to_numpy()
        cuts = ends[bounds - bounds[0]]
        return np.insert(ids, cuts[1:], END_ID).astype("<u4"), cuts + np.arange(len(cuts))


def encoder(path: str, limit: int = 1_000_000) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, limit) not in _ENCODERS:
        _ENCODERS[path, limit] = WordEncoder(path, limit)
    return _ENCODERS[path, limit]


def slices(batch: pa.RecordBatch, text: int, most_bytes: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold a bounded number of text bytes (or one long text)."""
    sizes = np.asarray(pc.binary_length(batch.column(text)).fill_null(0)).astype(np.int64)
    start = size = 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > most_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield batch.slice(start)
