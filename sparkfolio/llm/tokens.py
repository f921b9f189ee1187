"""Exact tokenizer output at speed: a text is cut where no token can cross, and each distinct unit is encoded once.

A cut lies between a character that is not white space and a following space or line feed. Neither
vocabulary here has a token or a pre-token that crosses such a place, so the units' ids concatenate to
the ids of the whole text; a vocabulary that ignores white space and case is given lower-cased words.
Texts with any other white space, a NUL or what may be a special token go to the library whole.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: NUL and every Unicode white space but space and line feed.
_OTHER_SPACE = "[\\x00\\x09\\x0b\\x0c\\x0d\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def vocabulary(name: str) -> str:
    """Path of a vocabulary file; a name with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _drops_space(tok) -> bool:
    """The vocabulary ignores white space and case: words can be cut out and lower-cased beforehand."""
    j = json.loads(tok.to_str())
    rules = [x["type"] for x in (j["normalizer"] or {}).get("normalizers", [])]
    split = [x for x in (j["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
    return "Lowercase" in rules and "Replace" in rules and any(x["invert"] and x["behavior"] == "Removed" for x in split)


class Encoder:
    """Encodes arrays of texts to (flat ids, offsets of each text). Up to `most` distinct units that came
    twice in one call keep their ids for later calls; others are encoded again when they return."""

    def __init__(self, path: str, most: int = 200_000):
        self.tok, self.most = tokenizer(path), most
        self.words = _drops_space(self.tok)
        added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items() if t.special}
        self.mark, self.mark_id = max(added.items(), key=lambda x: x[1])
        self.known, self.flat, self.length = pa.array([], pa.string()), np.empty(0, np.int32), np.empty(0, np.int64)

    def _ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of the units, one after the other, and each unit's number of ids. Units are encoded together with
        a special token between them, which the library always cuts out first."""
        flat = [np.empty(0, np.int32)]
        for at in range(0, len(units), 1000):
            got = self.tok.encode_batch_fast([self.mark.join(units[at : at + 1000])], add_special_tokens=False)[0].ids
            flat += [np.array(got, np.int32), np.array([self.mark_id], np.int32)]
        x = np.concatenate(flat)
        ends = np.flatnonzero(x == self.mark_id)
        return x[x != self.mark_id], np.diff(ends, prepend=-1) - 1

    def _table(self, units: pa.Array, count: np.ndarray) -> tuple[pa.ListArray, np.ndarray]:
        """Lists of ids, and for each of the distinct units the place of its list."""
        slot = pc.fill_null(pc.index_in(units, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(slot < 0)
        fresh, lens = self._ids(units.take(pa.array(new)).to_pylist())
        known = len(self.known)
        slot[new] = known + np.arange(len(new))
        length = np.concatenate([self.length, lens])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(np.concatenate([self.flat, fresh])))
        keep = np.flatnonzero(count[new] > 1)[: max(0, self.most - known)]
        if len(keep):
            self.flat = np.concatenate([self.flat, lists.take(pa.array(known + keep)).flatten().to_numpy()])
            self.length = np.concatenate([self.length, lens[keep]])
            self.known = pa.concat_arrays([self.known, units.take(pa.array(new[keep]))])
        return lists, slot

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        odd = pc.match_substring(texts, "<|", ignore_case=False)
        if not self.words:
            odd = pc.or_(odd, pc.match_substring_regex(texts, _OTHER_SPACE))
        if pc.any(odd).as_py():
            return self._mixed(texts, odd.to_numpy(zero_copy_only=False))
        return self._plain(texts)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.words:
            parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        else:
            parts = pc.split_pattern(pc.replace_substring_regex(texts, r"([^ \n])([ \n])", "\\1\x00\\2"), "\x00")
        units = parts.flatten().dictionary_encode()
        at = units.indices.to_numpy()
        lists, slot = self._table(units.dictionary, np.bincount(at, minlength=len(units.dictionary)))
        got = lists.take(pa.array(slot[at]))
        bounds = parts.offsets.to_numpy()
        return got.flatten().to_numpy(), got.offsets.to_numpy().astype(np.int64)[bounds - bounds[0]]

    def _mixed(self, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, offsets = self._plain(texts.filter(pa.array(~odd))) if not odd.all() else (np.empty(0, np.int32), np.zeros(1, np.int64))
        whole = iter(self.tok.encode_batch_fast(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False))
        plain = iter(range(len(offsets) - 1))
        out = [np.asarray(next(whole).ids, np.int32) if x else flat[offsets[k := next(plain)] : offsets[k + 1]] for x in odd]
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
