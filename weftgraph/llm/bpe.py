"""Byte-level BPE encoding with a pair occurrence index, and decoding.

The distinct pieces of a batch are laid out in one symbol array. An index maps each mergeable pair to all its positions;
active ranks are applied in ascending order, each to all positions of its pair at once, and the neighbours' new pairs
join the index. So one merge costs one array step for the whole batch, however many words contain it.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftgraph.llm.common import gathered, kept, sliced

#: Fixed value: the public pattern that splits a text before merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Code points that the regex module counts as letters or digits, and the Unicode version behind public
#: byte-level vocabularies does not know.
_LATER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
    r"\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    r"\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    r"\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    r"\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
    r"\U0003d000-\U0003fc3f"
)

#: Cutting a text at its spaces cuts between pieces, unless blanks stand in a run of three or in a pair at the end. The
#: other two rule most texts out at less cost: such a run holds one of these pairs or a blank that is rare.
_UNEVEN = regex.compile(r"\s{3}|\s\s\Z")
_PAIRS = ("  ", "\n\n", " \n", "\n ")
_RARE_BLANK = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Words of letters that every Unicode version knows, with a mark after them that is then a piece of its own.
_STOPS = ".,;:!?"
_PLAIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+[.,;:!?]?$"

#: Entries of a worker's cache of encoded words (the first to come, so the frequent ones), and the longest it keeps.
CACHE_WORDS, CACHE_CHARS = 300_000, 48

#: Bytes of text that are encoded at once. An index of pairs and a lookup in the cache cost much the same for few words as
#: for many, so small blocks pay them more often.
BLOCK_BYTES = 8_000_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next of U+0100 ff."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Runs:
    """Runs of ids: run i holds sizes[i] of them and begins at starts[i] of ids."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids, self.sizes = ids, sizes
        self.starts = np.cumsum(sizes) - sizes

    def with_more(self, other: Runs) -> Runs:
        return Runs(np.concatenate([self.ids, other.ids]), np.concatenate([self.sizes, other.sizes]))

    def take(self, at: np.ndarray) -> Runs:
        n = self.sizes[at]
        ends = np.cumsum(n)
        return Runs(self.ids[np.repeat(self.starts[at] - (ends - n), n) + np.arange(n.sum())], n)

    def grouped(self, at: np.ndarray, bounds: np.ndarray) -> Runs:
        """One run for each group at[bounds[i] : bounds[i + 1]] of runs."""
        taken = self.take(at)
        return Runs(taken.ids, np.diff(np.concatenate([[0], np.cumsum(taken.sizes)])[bounds]))

    def laid_out(self, at: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
        return self.grouped(at, bounds).packed()

    def packed(self) -> Iterator[bytes]:
        raw = self.ids.tobytes()
        return (raw[4 * i : 4 * (i + n)] for i, n in zip(self.starts.tolist(), self.sizes.tolist()))


class Encoder:
    """Encodes batches of texts with the vocabulary and merges of a tokenizer file (JSON, byte-level BPE)."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        self.cache_words = cache_words
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without normalizer and prefix space is expected")
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.byte_ids = np.array([vocab[s] for s in symbols], np.int32)
        self.width = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.ranks = {a * self.width + b: r for r, (a, b, _) in reversed([*enumerate(self.merges)])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = regex.compile(PIECES)
        later = PIECES.replace(r"?\p{L}+", rf"?[\p{{L}}--[{_LATER}]]+").replace(r"?\p{N}+", rf"?[\p{{N}}--[{_LATER}]]+")
        self.later = regex.compile("(?V1)" + later.replace(r"[^\s\p{L}\p{N}]+", rf"[[^\s\p{{L}}\p{{N}}]||[{_LATER}]]+"))
        self.has_later = regex.compile(f"[{_LATER}]")
        self.words, self.cached = pa.array([], pa.string()), Runs(np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def merge(self, text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, none empty, that lie one after another in text (bytes), and how many each has."""
        if not len(sizes):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        sym = self.byte_ids[text]
        total, ends = len(sym), np.cumsum(sizes)
        after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
        after[ends - 1] = -1
        before[(ends - sizes)] = -1
        index: dict[int, list[int]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            """Put the pairs that begin at these positions into the index."""
            codes = sym[at].astype(np.int64) * self.width + sym[after[at]]
            if len(at) < 200:
                for p, code in zip(at.tolist(), codes.tolist()):
                    if (rank := self.ranks.get(code)) is not None:
                        if rank not in index:
                            index[rank] = []
                            heapq.heappush(active, rank)
                        index[rank].append(p)
                return
            order = np.argsort(codes, kind="stable")
            codes, at = codes[order], at[order]
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])).tolist()
            for i, j in zip(starts, [*starts[1:], len(codes)]):
                if (rank := self.ranks.get(int(codes[i]))) is not None:
                    if rank not in index:
                        index[rank] = []
                        heapq.heappush(active, rank)
                    index[rank].extend(at[i:j].tolist())

        add(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            left, right, made = self.merges[rank]
            at = np.sort(np.array(index.pop(rank), np.int64))
            nxt = after[at]
            good = (sym[at] == left) & (nxt >= 0) & (sym[nxt] == right)
            good[1:] &= at[1:] != at[:-1]
            at, nxt = at[good], nxt[good]
            if left == right and len(at) > 1:
                # In a run of equal symbols every second position merges, from the left.
                chained = np.concatenate([[False], nxt[:-1] == at[1:]])
                heads = np.flatnonzero(~chained)
                within = np.arange(len(at)) - heads[np.cumsum(~chained) - 1]
                at, nxt = at[within % 2 == 0], nxt[within % 2 == 0]
            if not len(at):
                continue
            sym[at] = made
            sym[nxt] = -1
            beyond = after[nxt]
            after[at] = beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            prior = before[at]
            add(np.concatenate([at[has], prior[prior >= 0]]))
        alive = sym >= 0
        return sym[alive].astype(np.uint32), np.add.reduceat(alive.astype(np.int64), ends - sizes)

    def pieces(self, text: str) -> list[str]:
        """The pieces that merges never cross."""
        if text.isascii() or not self.has_later.search(text):
            return self.known.findall(text)
        return self.later.findall(text)

    def _split(self, text: str) -> list[str]:
        """The pieces of any text, special tokens among them."""
        if self.at_special is None or not any(s in text for s in self.special):
            return self.pieces(text)
        parts = [p for p in self.at_special.split(text) if p]
        return [x for p in parts for x in ([p] if p in self.special else self.pieces(p))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: none) as little-endian unsigned 32-bit bytes."""
        plain = [i for i, t in enumerate(texts) if t and not (_is_uneven(t) or any(s in t for s in self.special))]
        out = [b""] * len(texts)
        for i, ids in zip(plain, self._encode([texts[i] for i in plain])):
            out[i] = ids
        rest = sorted({i for i, t in enumerate(texts) if t}.difference(plain))
        for i, ids in zip(rest, self._joined([self._split(texts[i]) for i in rest]).packed()):
            out[i] = ids
        return out

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of texts that may be cut at their spaces: distinct words are looked up and their ids laid out again."""
        words = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = words.values.dictionary_encode()
        at, bounds = coded.indices.to_numpy().astype(np.int64), words.offsets.to_numpy()
        # The first word of a text has no space before it.
        firsts = bounds[:-1]
        heads = self._joined([self.pieces(w) if w else [] for w in words.values.take(pa.array(firsts)).to_pylist()])
        found, place = self._looked_up(coded.dictionary)
        at = place[at]
        at[firsts] = len(found.sizes) + np.arange(len(texts))
        return found.with_more(heads).laid_out(at, bounds)

    def _looked_up(self, words: pa.Array) -> tuple[Runs, np.ndarray]:
        """Runs of ids, and the one of each distinct word after a space; the first CACHE_WORDS words to come stay known."""
        place = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        new = words.filter(pa.array(place < 0))
        made = self._fresh(new)
        found = self.cached.with_more(made)
        place[place < 0] = len(self.words) + np.arange(len(new))
        if (room := self.cache_words - len(self.words)) > 0:
            short = np.flatnonzero(pc.utf8_length(new).to_numpy() <= CACHE_CHARS)[:room]
            self.words = pa.concat_arrays([self.words, new.take(pa.array(short))])
            self.cached = self.cached.with_more(made.take(short))
        return found, place

    def _fresh(self, new: pa.Array) -> Runs:
        """Runs of new distinct words. Plain ones are one piece with their space, and a mark that may follow is a second."""
        plain = pc.match_substring_regex(new, _PLAIN)
        is_plain = plain.to_numpy(zero_copy_only=False)
        whole = new.filter(plain)
        cut = pc.utf8_rtrim(whole, _STOPS).dictionary_encode()
        stems, of = cut.dictionary, cut.indices.to_numpy()
        place = pc.index_in(stems, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        unknown = pc.binary_join_element_wise(pa.scalar(" "), stems.filter(pa.array(place < 0)), "")
        place[place < 0] = len(self.words) + np.arange(len(unknown))
        runs = self.cached.with_more(Runs(*self.merge(*_flat(unknown))))
        marks = pc.utf8_slice_codeunits(whole, -1).to_numpy(zero_copy_only=False)
        marked = np.array([x in _STOPS for x in marks], bool)
        marks_at = len(runs.sizes) + np.array([_STOPS.index(x) for x in marks[marked]], np.int64)
        runs = runs.with_more(self._joined([[x] for x in _STOPS]))
        n = 1 + marked.astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(n)])
        at = np.empty(bounds[-1], np.int64)
        at[bounds[:-1]] = place[of]
        at[bounds[1:][marked] - 1] = marks_at
        # Words that need the full pattern come after, and all go back to their order.
        odd = self._joined([self.pieces(" " + w) for w in new.filter(pc.invert(plain)).to_pylist()])
        order = np.empty(len(new), np.int64)
        order[is_plain] = np.arange(len(whole))
        order[~is_plain] = len(whole) + np.arange(len(new) - len(whole))
        return runs.grouped(at, bounds).with_more(odd).take(order)

    def _joined(self, split: list[list[str]]) -> Runs:
        """The ids of lists of pieces, a run for each list."""
        distinct = list(set().union(*split).difference(self.special))
        raw = [p.encode("utf-8", "surrogatepass") for p in distinct]
        runs = Runs(*self.merge(np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))))
        runs = runs.with_more(Runs(np.array([*self.special.values()], np.uint32), np.ones(len(self.special), np.int64)))
        place = {p: i for i, p in enumerate([*distinct, *self.special])}
        at = np.fromiter((place[p] for own in split for p in own), np.int64)
        return runs.grouped(at, np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))]))


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of words one after another, and their sizes."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(words) else np.zeros(0, np.uint8)
    return data, np.diff(offsets).astype(np.int64)


def _is_uneven(text: str) -> bool:
    return bool((any(pair in text for pair in _PAIRS) or _RARE_BLANK.search(text)) and _UNEVEN.search(text))


class Decoder:
    """The bytes of each id of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, to_byte = spec["model"]["vocab"], {s: b for b, s in enumerate(byte_symbols())}
        self.token_bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for t in spec["added_tokens"]:
            self.token_bytes[t["id"]] = t["content"].encode()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file, so that its word cache outlives a task."""
    return Encoder(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def text_blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches joined or cut so that their texts hold about BLOCK_BYTES."""
    return sliced(gathered(batches, column, BLOCK_BYTES), column, BLOCK_BYTES)


def encode_column(df: DataFrame, text: str, keep: list[str], tokenizer: str, decoded: bool = False) -> DataFrame:
    """keep columns and ids (array<int>): every whole text encoded without special tokens added; with decoded also the
    text of these ids, as decode_column gives it, made in the same task.

    Null and empty texts give an empty array. Special tokens' strings in a text become their ids, as the tokenizers
    library does by default. Rows stand alone; an empty table gives no rows; other columns are dropped, and a column
    of keep that is named like a result gives way to it. tokenizer is a path that every worker can open.
    """
    keep = kept(keep, ["ids", "decoded"] if decoded else ["ids"])
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    if decoded:
        schema = schema.add("decoded", T.StringType())
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in text_blocks(batches, len(keep)):
            made = enc.encode(batch.column(len(keep)).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in made])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(made), np.int32), pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(offsets), values)
            cols = [*[batch.column(i) for i in range(len(keep))], ids]
            if decoded:
                dec = decoder(tokenizer)
                cols.append(pa.array([dec.decode(np.frombuffer(x, np.int32).tolist()) for x in made], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.select(*[df[k] for k in keep], df[text].alias("__text")).mapInArrow(run, schema)


def decode_column(df: DataFrame, ids: str, keep: list[str], tokenizer: str) -> DataFrame:
    """keep columns and decoded: the text of each id array, special tokens included; null ids give null."""
    keep = kept(keep, ["decoded"])
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = decoder(tokenizer)
        for batch in sliced(batches, len(keep)):
            texts = [dec.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in batch.column(len(keep))]
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return df.select(*[df[k] for k in keep], df[ids].alias("__ids")).mapInArrow(run, schema)
