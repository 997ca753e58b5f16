"""Many phrases found in many texts at once, on the bytes of whole Arrow batches.

Phrases are compiled to arrays: their bytes, and for each its first word. The words of a batch, runs of lower-case
letters, digits and underscores of ASCII, are found by a mask over all bytes, and each word looks up the phrases that it begins in one sorted
search for the whole batch. What is found is compared byte by byte, phrases of one length together, and the mask tells whether
a word character stands at either edge. No text is handled by itself; the cost follows the words of the texts and the phrases
that begin with them, not the number of phrases.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PAIRS = 1 << 20  # places and phrases compared at once
_HEAD = 8  # bytes of a word that, with its length, choose the phrases to compare


_WORD = np.zeros(256, bool)  # of lower-case texts; must not stand next to a phrase
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789_")] = True


def _keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number per word from its first bytes and its length; equal words have equal ones."""
    keys = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(_HEAD):
        inside = np.flatnonzero(sizes > k)
        keys[inside] += data[starts[inside] + k].astype(np.uint64) << np.uint64(8 * k)
    return keys


def _words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that begin at ``edges``; no word reaches across an edge."""
    inside = np.append(_WORD[data], False)
    before = np.append(False, inside[:-1])
    cut = np.zeros(len(inside) + 1, bool)
    cut[edges] = True
    begins = inside & (~before | cut[:-1])
    closes = before & (~inside | cut[:-1])
    return np.flatnonzero(begins), np.flatnonzero(closes)


class Dictionary:
    """``phrases`` and the name of each; a name may have several. Phrases are not empty."""

    def __init__(self, phrases: list[str], names: list[str]):
        self.names = sorted(set(names))
        number = {name: k for k, name in enumerate(self.names)}
        blobs = [p.encode() for p in phrases]
        self.data = np.frombuffer(b"".join(blobs), np.uint8)
        ends = np.cumsum([0, *map(len, blobs)])
        starts, stops = _words(self.data, ends[:-1])
        first = np.searchsorted(starts, ends[:-1])
        worded = (first < len(starts)) & (np.append(starts, ends[-1])[first] < ends[1:])
        self.name = np.array([number[n] for n in names], np.int64)
        self.bare = [(p, int(n)) for p, n, w in zip(phrases, self.name, worded, strict=True) if not w]  # no word to look up
        some = np.flatnonzero(worded)
        at = first[some]
        keys = _keys(self.data, starts[at], stops[at] - starts[at])
        order = np.argsort(keys, kind="stable")
        some, keys, at = some[order], keys[order], at[order]
        self.keys, self.begin = np.unique(keys, return_index=True)
        self.count = np.diff(np.append(self.begin, len(keys)))
        self.at, self.size = ends[some], ends[some + 1] - ends[some]
        self.lead = starts[at] - ends[some]  # bytes before the first word
        self.of = self.name[some]

    def find(self, texts: pa.Array) -> pa.Array:
        """The sorted names whose phrases stand in each text, with no word character at their edges; a null text has none."""
        plain = pc.fill_null(texts.cast(pa.large_string()), "")
        count = len(plain)
        if not count:
            return pa.array([], pa.list_(pa.string()))
        _, offsets, values = plain.buffers()
        edges = np.frombuffer(offsets, np.int64)[plain.offset : plain.offset + count + 1]
        data = np.frombuffer(values, np.uint8)[edges[0] : edges[-1]] if values is not None else np.zeros(0, np.uint8)
        edges = edges - edges[0]
        starts, stops = _words(data, edges[:-1])
        found = [self._bare(plain)]
        if len(self.keys) and len(starts):
            key = _keys(data, starts, stops - starts)
            row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[row] == key)
            many = np.cumsum(self.count[row[hit]])
            begin = 0
            while begin < len(hit):
                done = many[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(many, done + _PAIRS, side="right")))
                found.append(self._compare(data, edges, starts[hit[begin:end]], row[hit[begin:end]]))
                begin = end
        pairs = np.unique(np.concatenate(found))
        text, name = pairs // max(len(self.names), 1), pairs % max(len(self.names), 1)
        ends = np.searchsorted(text, np.arange(count + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(self.names, pa.string()).take(pa.array(name)))

    def _compare(self, data: np.ndarray, edges: np.ndarray, starts: np.ndarray, row: np.ndarray) -> np.ndarray:
        """(text, name) as one number, of the phrases that stand where their first word was found."""
        many = self.count[row]
        phrase = np.repeat(self.begin[row] - np.cumsum(many) + many, many) + np.arange(many.sum())
        low = np.repeat(starts, many) - self.lead[phrase]
        high = low + self.size[phrase]
        text = np.searchsorted(edges, np.repeat(starts, many), side="right") - 1
        whole = (low >= edges[text]) & (high <= edges[text + 1])
        edge = np.append(_WORD[data], False)
        whole[whole] &= ~(edge[low[whole] - 1] & (low[whole] > edges[text[whole]]))
        whole[whole] &= ~(edge[high[whole]] & (high[whole] < edges[text[whole] + 1]))
        phrase, low, text = phrase[whole], low[whole], text[whole]
        same = np.zeros(len(phrase), bool)
        for size in np.unique(self.size[phrase]).tolist():
            of_size = np.flatnonzero(self.size[phrase] == size)
            step = max(1, _PAIRS * 8 // size)
            for at in range(0, len(of_size), step):
                some = of_size[at : at + step]
                places = np.arange(size)
                same[some] = (data[low[some, None] + places] == self.data[self.at[phrase[some], None] + places]).all(axis=1)
        return text[same] * max(len(self.names), 1) + self.of[phrase[same]]

    def _bare(self, texts: pa.Array) -> np.ndarray:
        """The same for phrases of marks alone, which no word can look up."""
        found = []
        for phrase, name in self.bare:
            hits = np.flatnonzero(pc.match_substring(texts, phrase).to_numpy(zero_copy_only=False))
            for t in hits.tolist():
                text, at = texts[t].as_py().encode(), -1
                mark = phrase.encode()
                while (at := text.find(mark, at + 1)) >= 0:
                    after = at + len(mark)
                    if not (at and _WORD[text[at - 1]]) and not (after < len(text) and _WORD[text[after]]):
                        found.append(t * max(len(self.names), 1) + name)
                        break
        return np.array(found, np.int64)
