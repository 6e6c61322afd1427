"""Byte-level BPE: encoding in batched numpy merge rounds, and decoding.

The distinct words of a batch stand in one flat array of symbols. Each round looks up the rank of all neighbouring
pairs by binary search over the sorted pair keys and merges, in every word, the places of its lowest-ranked pair.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import whole_text
from tessitura.llm.words import slide, sum_hashes

# The endings that byte-level BPE cuts off after an apostrophe.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
BLANKS = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, BLANK = range(4)
#: Code points that are handled at once; a longer text is cut before white space, where a word must begin.
GROUP = 1 << 20
NO_RANK = np.int64(2**62)
#: Words of more bytes than this go through rounds of their own, in which all places merge that are least within reach; of two generations
#: of words that a worker remembers each holds so many.
LONG, REMEMBERED = 256, 50_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _classes() -> np.ndarray:
    """The kind of every code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), "<u4")] = kind
    out[BLANKS] = BLANK
    return out


@dataclass
class Vocabulary:
    """A byte-level BPE vocabulary as sorted arrays; small (a few MB), so it may be broadcast."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    tokens: list[bytes]
    special: dict[str, int]
    classes: np.ndarray
    young: dict[str, bytes] = field(default_factory=dict)
    old: dict[str, bytes] = field(default_factory=dict)

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        """Reads a tokenizers JSON file whose model is BPE over ByteLevel without normalizer; one with anything else that changes ids is refused."""
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        _refuse_others(raw)
        ids = raw["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        special = {x["content"]: x["id"] for x in raw["added_tokens"]}
        size = max([*ids.values(), *special.values()]) + 1
        tokens = [b""] * size
        for token, i in ids.items():
            tokens[i] = bytes(back[c] for c in token)
        for token, i in special.items():
            tokens[i] = token.encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in raw["model"]["merges"]]
        keys = np.array([ids[a] * 2**32 + ids[b] for a, b in pairs], np.int64)
        merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        # Places of one rank merge at once, which is right if no merge makes a pair of a lower rank.
        made = np.full(size, -1, np.int64)
        np.maximum.at(made, merged, np.arange(len(pairs)))
        if len(pairs) and (np.maximum(made[keys >> 32], made[keys & 0xFFFFFFFF]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge comes before the merges that make its parts")
        order = np.argsort(keys)
        return cls(np.array([ids[c] for c in letters], np.int64), keys[order], order.astype(np.int64), merged[order], tokens, special, _classes())

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_flat"} | {"young": {}, "old": {}}

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * 2**32 + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK), at

    def _rounds(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian uint32 bytes."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        while len(sym):
            inside = np.append(word[1:] == word[:-1], False)
            rank, at = self._find(sym, np.append(sym[1:], 0))
            rank[~inside] = NO_RANK
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            length = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            done = least == NO_RANK
            data = sym.astype("<u4").tobytes()
            for s, n in zip(starts[done].tolist(), length[done].tolist()):
                out[word[s]] = data[4 * s : 4 * (s + n)]
            active = np.repeat(~done, length)
            hit = np.flatnonzero((rank == np.repeat(least, length)) & active)
            # In a run of overlapping places, as in "aaaa", every second one merges, from the left.
            first = np.append(True, np.diff(hit) != 1) if len(hit) else np.zeros(0, bool)
            step = np.arange(len(hit)) - np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0)) if len(hit) else hit
            hit = hit[step % 2 == 0]
            sym[hit] = self.merged[at[hit]]
            active[hit + 1] = False
            sym, word = sym[active], word[active]
        return out

    def _long(self, word: bytes) -> bytes:
        """One long word, in rounds. A place merges if no rank within reach of it is lower: what could still change its two symbols would have to
        grow from farther than the longest token. A run of neighbouring places of one rank, as in "aaaa", merges as a whole, every second place."""
        sym = self.byte_ids[np.frombuffer(word, np.uint8)]
        rank, at = self._find(sym[:-1], sym[1:])
        reach = max(map(len, self.tokens))
        rim = np.full(reach, NO_RANK)
        while (rank < NO_RANK).any():
            least = slide(np.concatenate([rim, rank, rim]), 2 * reach + 1, np.minimum)
            run = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
            size = np.diff(np.append(run, len(rank)))
            ready = np.logical_and.reduceat((rank == least) & (rank < NO_RANK), run)
            hit = np.flatnonzero(np.repeat(ready, size) & ((np.arange(len(rank)) - np.repeat(run, size)) % 2 == 0))
            sym[hit] = self.merged[at[hit]]
            sym, rank, at = np.delete(sym, hit + 1), np.delete(rank, hit), np.delete(at, hit)
            # The pairs on both sides of each new symbol.
            new = hit - np.arange(len(hit))
            new = np.unique(np.concatenate([new - 1, new]))
            new = new[(new >= 0) & (new < len(rank))]
            rank[new], at[new] = self._find(sym[new], sym[new + 1])
        return sym.astype("<u4").tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        raw = [w.encode() for w in words]
        short = [i for i, w in enumerate(raw) if len(w) <= LONG]
        found = {words[i]: self._long(raw[i]) for i in range(len(raw)) if len(raw[i]) > LONG}
        for s in range(0, len(short), 20_000):
            part = short[s : s + 20_000]
            found.update(zip([words[i] for i in part], self._rounds([raw[i] for i in part])))
        return found

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of words, learnt where they aren't remembered. When a generation is full, the words that it didn't need are forgotten."""
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        for w in words:
            if w not in young and (x := old.get(w)) is not None:
                young[w] = x
        new = [w for w in dict.fromkeys(words) if w not in young]
        if new:
            young.update(self._learn(new))
        return [young[w] for w in words]

    def _word_starts(self, cps: np.ndarray, segments: np.ndarray) -> np.ndarray:
        """True where a word begins. segments: where texts or parts of texts begin, at least one code point each."""
        n, kind = len(cps), self.classes[cps]
        cut = np.zeros(n + 1, bool)
        cut[segments] = cut[n] = True
        runs = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]) | cut[:n])
        begin = np.zeros(n + 1, bool)
        begin[runs] = True
        # The last blank before other text: a space goes with what follows, another blank stands alone.
        after = np.append(runs[1:], n)
        last = after[(kind[runs] == BLANK) & ~cut[after]] - 1
        begin[last] = True
        begin[last[cps[last] == 0x20] + 1] = False
        p = np.flatnonzero((cps == 0x27) & begin[:n])
        p = p[~cut[p + 1]]
        one = p[np.isin(cps[p + 1], [ord(x) for x in ENDINGS if len(x) == 1])]
        two = p[~cut[np.minimum(p + 2, n)]]
        pair = cps[two + 1].astype(np.int64) * 2**21 + cps[two + 2]
        two = two[np.isin(pair, [ord(x[0]) * 2**21 + ord(x[1]) for x in ENDINGS if len(x) == 2])]
        begin[one + 1] = begin[two + 1] = False
        begin[one + 2] = begin[two + 3] = True
        return begin[:n]

    def _encode_group(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of parts of texts, each not empty."""
        whole = "".join(parts)
        cps = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        bounds = np.append(0, np.cumsum(sizes))
        starts = np.flatnonzero(self._word_starts(cps, bounds[:-1]))
        ends = np.append(starts[1:], len(cps))
        size = ends - starts
        _, first, of = np.unique(sum_hashes(cps, size), return_index=True, return_inverse=True)
        words = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        # Equal hashes only propose: words that differ from the one that stands for their hash get numbers of their own.
        twin = first[of]
        other = np.minimum(np.repeat(starts[twin] - starts, size) + np.arange(len(cps)), len(cps) - 1)
        for i in np.flatnonzero((size != size[twin]) | (np.add.reduceat((cps != cps[other]).view(np.int8), starts, dtype=np.int64) > 0)).tolist():
            words.append(whole[starts[i] : ends[i]])
            of[i] = len(words) - 1
        ids = self._ids_of(words)
        flat = np.frombuffer(b"".join(ids), "<u4")
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        out, at = _gather(flat, np.cumsum(count) - count, count, of)
        return np.split(out, at[np.searchsorted(starts, bounds[1:-1])])

    def _parts(self, text: str) -> Iterator[str]:
        """A text without special tokens in parts of about GROUP code points, cut where a blank follows another character."""
        at = 0
        while len(text) - at > GROUP:
            m = _EDGE.search(text, at + GROUP)
            if not m:
                break
            yield text[at : m.start() + 1]
            at = m.start() + 1
        if at < len(text):
            yield text[at:]

    def encode_many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids (uint32) of whole texts, one array a text, in order; strings of special tokens give their ids."""
        queue: list[tuple[int, str | int]] = []
        size = 0
        pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

        def flush(upto: int) -> Iterator[np.ndarray]:
            parts = [p for _, p in queue if isinstance(p, str)]
            done = iter(self._encode_group(parts) if parts else [])
            for i, p in queue:
                held[i - base].append(next(done) if isinstance(p, str) else np.array([p], np.uint32))
            for ids in held[: upto - base]:
                yield np.concatenate(ids) if ids else np.zeros(0, np.uint32)

        base, held = 0, []
        for i, text in enumerate(texts):
            held.append([])
            pieces = pattern.split(text) if pattern and any(x in text for x in self.special) else [text]
            for k, piece in enumerate(pieces):
                if k % 2:
                    queue.append((i, self.special[piece]))
                    continue
                for part in self._parts(piece):
                    queue.append((i, part))
                    size += len(part)
                    if size >= GROUP:
                        yield from flush(i)
                        held, base, queue, size = held[i - base :], i, [], 0
        yield from flush(len(texts))

    def decode_many(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of ids; bytes that are not UTF-8 become U+FFFD."""
        flat, off, size = self._token_arrays()
        out = []
        for x in ids:
            done = [_gather(flat, off, size, x[s : s + GROUP])[0].tobytes() for s in range(0, len(x), GROUP)]
            out.append(b"".join(done).decode("utf-8", "replace"))
        return out

    def _token_arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if "_flat" not in self.__dict__:
            size = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
            self._flat = np.frombuffer(b"".join(self.tokens), np.uint8), np.cumsum(size) - size, size
        return self._flat


def _refuse_others(raw: dict) -> None:
    """Ends with an error where a file asks for steps that this encoder doesn't take."""
    model, split = raw["model"], raw.get("pre_tokenizer") or {}
    wrong = [
        ("normalizer", raw.get("normalizer")), ("model type", model.get("type", "BPE") != "BPE"), *((k, model.get(k)) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        ("pre-tokenizer", split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True)),
        ("added tokens that strip blanks or ask for single words", any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in raw.get("added_tokens", []))),
    ]
    if found := [name for name, on in wrong if on]:
        raise ValueError(f"not a plain byte-level BPE file: {', '.join(found)}")


_EDGE = regex.compile("[^%s][%s]" % ((regex.escape("".join(map(chr, BLANKS))),) * 2))


def _gather(flat: np.ndarray, off: np.ndarray, size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces flat[off[k] : off[k] + size[k]] for k in of, joined; and where each begins."""
    count = size[of]
    begin = np.cumsum(count) - count
    return flat[np.repeat(off[of] - begin, count) + np.arange(int(count.sum()))], begin


#: Characters after which a worker hands on what it has done.
OUTPUT = 1 << 22


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_decoded: bool = True) -> DataFrame:
    """One row for each input row: id, n_tokens, ids_sha256, decoded_sha256 and, as asked for, ids (array<int>) and decoded.

    ``path``: a vocabulary file that the driver can read. Null and empty texts have no tokens; very long texts go in parts that no word crosses; rows with
    null or repeated ids stay; an empty table gives an empty table; other columns are not read."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.from_file(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary.value
        for batch in batches:
            rows, size, begin = [], 0, 0
            for k, ids in enumerate(v.encode_many(batch["__text"].tolist()), 1):
                (decoded,) = v.decode_many([ids])
                rows.append((len(ids), sha256(ids.astype("<u4").tobytes()).hexdigest(), sha256(decoded.encode()).hexdigest()) + (ids.astype(np.int32),) * with_ids + (decoded,) * with_decoded)
                size += len(decoded)
                if size >= OUTPUT or k == len(batch):
                    yield pd.concat([batch["__id"].iloc[begin:k].rename(id_col).reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)
                    rows, size, begin = [], 0, k

    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids + ["decoded"] * with_decoded
    extra = ", ids array<int>" * with_ids + ", decoded string" * with_decoded
    # Ids travel as text: beside nulls, pandas would make floats of them.
    given = docs.select(F.col(id_col).cast("long").cast("string").alias("__id"), whole_text(text_col).alias("__text"))
    done = given.mapInPandas(run, f"{id_col} string, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
    return done.withColumn(id_col, F.col(id_col).cast("long"))
