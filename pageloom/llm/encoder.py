"""Token ids of whole texts, through the tokenizers library."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words of these letters have no contraction, no composition and one lower-case form, so a tokenizer that
# splits at white space and lower-cases gives each of them one run of ids, whatever stands around it.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_POINTS = ".,!?;:"
_JOIN = 200


class IdEncoder:
    """Encodes texts as unsigned 32-bit ids, each text followed by an end id.

    A tokenizer that drops white space encodes every word on its own. So Arrow cuts the texts of a batch at ASCII
    white space, numbers their distinct words, and from these their distinct stems (plain words without case and
    a point behind them, other words as they are). Stems are looked up among the known ones, and only new
    ones are encoded. Ids are then gathered from stems to words and from words to texts. When more than ``remember`` stems
    are known, only those of the current batch are kept. A tokenizer that keeps white space encodes whole texts.
    """

    def __init__(self, path: str, end_id: int, remember: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.end = end_id
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.remember = remember
        last = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.closes = np.zeros(max(self.vocabulary, max(last, default=0) + 1), bool)
        self.closes[last] = True
        one, two, apart = self._whole(["a", "b", " \n\ta\r\n\x0b\x0cb\n"])
        self.by_word = apart == one + two
        alone, behind = self._whole(list(_POINTS)), self._whole([f"A{p}" for p in _POINTS])
        points = [p for p, x, y in zip(_POINTS, alone, behind) if len(x) == 4 and y == one + x]
        self.points = pa.array(points, pa.string())
        self.point_ids = np.array([np.frombuffer(alone[_POINTS.index(p)], "<u4")[0] for p in points], "<u4")
        self.plain = f"^[{_LETTERS}]+" + (f"[{''.join(points)}]?$" if points else "$")
        # Lower-case ASCII words need no normalising; a tokenizer without that step must agree on those of the vocabulary.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        sample = sorted({t.removesuffix("</w>") for t in self.tokenizer.get_vocab() if re.fullmatch("[a-z]+(</w>)?", t)})[::20]
        both = [[x.ids for x in t.encode_batch_fast([" ".join(sample), *sample], add_special_tokens=False)]
                for t in (self.tokenizer, self.bare)]
        if both[0] != both[1]:
            self.bare = self.tokenizer
        self.forget()

    def forget(self) -> None:
        """Drop the known stems, as at the end of a task."""
        self.known = pa.array([], pa.string())
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4")

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _joined(self, words: list[str], tokenizer) -> list[bytes]:
        """Ids of plain words, encoded in joined strings; an id that closes a word tells them apart."""
        out: list[bytes] = []
        joined = [" ".join(words[i:i + _JOIN]) for i in range(0, len(words), _JOIN)]
        for k, x in enumerate(tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            mine = words[k * _JOIN:(k + 1) * _JOIN]
            ids = np.array(x.ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(mine) or ends[-1] != len(ids):
                out += self._whole(mine)
                continue
            raw, stops = ids.tobytes(), (ends * 4).tolist()
            out += [raw[a:b] for a, b in zip([0, *stops], stops)]
        return out

    def _places(self, stems: pa.Array, plain: np.ndarray) -> np.ndarray:
        """Places of distinct stems among the known ones; new ones are encoded and added."""
        at = pc.fill_null(pc.index_in(stems, self.known), -1).to_numpy().astype(np.int64)
        if len(self.known) > self.remember:
            kept = at[at >= 0]
            sizes = self.size[kept]
            self.ids = self.ids[gathered(self.begin[kept], sizes)]
            self.known, self.size, self.begin = self.known.take(pa.array(kept)), sizes, np.cumsum(sizes, dtype=np.int64) - sizes
            at[at >= 0] = np.arange(len(kept))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = stems.take(pa.array(new))
            kind = np.where(plain[new], pc.string_is_ascii(fresh).to_numpy(zero_copy_only=False) + 0, 2)
            order = np.argsort(kind, kind="stable")
            new, fresh, (a, b) = new[order], fresh.take(pa.array(order)), np.searchsorted(kind[order], [1, 2])
            words = fresh.to_pylist()
            found = (self._joined(words[:a], self.tokenizer) + self._joined(words[a:b], self.bare)
                     + (self._whole(words[b:]) if b < len(words) else []))
            sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])
            at[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known = pa.concat_arrays([self.known, fresh])
        return at

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text ends in them; a null text counts as empty."""
        if not self.by_word:
            found = [np.frombuffer(x, "<u4") for x in self._whole(["" if t is None else t for t in texts.to_pylist()])]
            ends = np.cumsum([len(x) + 1 for x in found], dtype=np.int64)
            return np.concatenate([np.append(x, np.uint32(self.end)) for x in found] or [np.zeros(0, "<u4")]).astype("<u4"), ends
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.dictionary_encode()
        words, which = coded.dictionary, coded.indices.to_numpy()
        is_plain = pc.match_substring_regex(words, self.plain)
        stem = pc.if_else(is_plain, pc.utf8_rtrim(pc.utf8_lower(words), _POINTS), words).dictionary_encode()
        is_plain = is_plain.to_numpy(zero_copy_only=False)
        of = stem.indices.to_numpy()
        plain = np.zeros(len(stem.dictionary), bool)
        plain[of[is_plain]] = True
        at = self._places(stem.dictionary, plain)[of]
        point = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(words, -1), self.points), -1).to_numpy()
        pointed = is_plain & (point >= 0)
        ends = np.cumsum(self.size[at] + pointed, dtype=np.int64)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, "<u4")
        body = np.ones(len(ids), bool)
        body[ends[pointed] - 1] = False
        ids[~body] = self.point_ids[point[pointed]]
        ids[body] = self.ids[gathered(self.begin[at], self.size[at])]
        size = np.diff(ends, prepend=0)
        before = np.append(0, np.cumsum(size[which], dtype=np.int64))
        last = np.cumsum(np.diff(before[split.offsets.to_numpy()]) + 1)
        out = np.empty(int(before[-1]) + len(last), "<u4")
        inside = np.ones(len(out), bool)
        inside[last - 1] = False
        out[~inside] = self.end
        out[inside] = ids[gathered((ends - size)[which], size[which])]
        return out, last

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text and the end id, as bytes."""
        ids, ends = self.encode_array(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]), ends)] if texts else []


def gathered(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all runs of ``size`` from ``begin``, one after the other."""
    ends = np.cumsum(size, dtype=np.int64)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> IdEncoder:
    """One encoder for each Python worker."""
    return IdEncoder(path, end_id)


def word_bpe_path() -> str:
    """The installed public word-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
