"""Texts cut into chunks that a tokenizer treats independently, each distinct one encoded once."""

from __future__ import annotations

import gc
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from moodloom.llm.common import steps

CUT = "\x1f"
#: Bytes of text whose chunks are looked up at once.
STEP = 1 << 20


def cut_plain(texts: pa.Array, points: bool) -> pa.Array:
    """Lists of chunks: cuts before each space, around each line end, and with ``points``
    between a letter and a following point or comma."""
    marked = pc.replace_substring(texts, " ", CUT + " ")
    marked = pc.replace_substring(marked, "\n", f"{CUT}\n{CUT}")
    if points:
        marked = pc.replace_substring_regex(marked, r"(\pL)([.,])", rf"\1{CUT}\2")
    return pc.split_pattern(marked, CUT)


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces flat[starts[i] : starts[i] + sizes[i]] one after another."""
    total = int(sizes.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(sizes)
    return flat[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


def _places(known: dict[str, int], chunks: list[str]) -> np.ndarray:
    """The number of each chunk, -1 for one that is not known."""
    return np.fromiter(map(known.get, chunks, repeat(-1)), np.int64, len(chunks))


class Encoder:
    """Ids of whole texts by way of their distinct chunks.

    ``odd`` is a pattern of texts that need ``cut_odd`` (a list of chunks);
    ``encode`` turns a list of distinct chunks into lists of ids. ``first`` is put
    before the first chunk of a text. A worker remembers up to ``remembered``
    distinct chunks over all its tasks, in two halves: when the younger one is full it
    becomes the older one, whose chunks come back as they are met again, so rare chunks
    go and frequent ones stay. ``step_bytes`` of text are cut at once: a longer step meets
    a chunk less often again, and takes more memory.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], list[list[int]]],
        odd: str,
        cut_odd: Callable[[str], list[str]],
        first: str = "",
        points: bool = False,
        remembered: int = 400_000,
        step_bytes: int = STEP,
    ):
        self.encode, self.odd, self.cut_odd, self.first, self.points = encode, odd, cut_odd, first, points
        self.remembered, self.step_bytes = remembered, step_bytes
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.older = (self.known, self.flat, self.starts, self.sizes)

    def age(self) -> None:
        """What is known becomes the older half; the half before it goes."""
        older = (self.known, self.flat, self.starts, self.sizes)
        self.forget()
        self.older = older

    def learn(self, chunks: list[str]) -> np.ndarray:
        """Numbers of distinct chunks."""
        number = _places(self.known, chunks)
        lost = np.flatnonzero(number < 0)
        if not len(lost):
            return number
        if self.known and len(self.known) + len(lost) > self.remembered // 2:
            self.age()
            lost = np.arange(len(chunks))
        known, flat, starts, sizes = self.older
        new = [chunks[i] for i in lost.tolist()] if len(lost) < len(chunks) else chunks
        at = _places(known, new) if known and known is not self.known else np.full(len(new), -1, np.int64)
        # Chunks of the older half first, then those that are encoded now.
        order = np.argsort(at < 0, kind="stable")
        met = at[order][: int((at >= 0).sum())]
        new = [new[i] for i in order.tolist()] if len(met) else new
        ids = self._encoded(new[len(met) :])
        more = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.r_[gather(flat, starts[met], sizes[met]), np.fromiter(chain.from_iterable(ids), np.int32, int(more.sum()))]
        sizes = np.r_[sizes[met], more]
        number[lost[order]] = np.arange(len(self.known), len(self.known) + len(new))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(sizes) - sizes]
        self.sizes = np.r_[self.sizes, sizes]
        self.flat = np.r_[self.flat, flat]
        return number

    def _encoded(self, chunks: list[str]) -> list[list[int]]:
        """Many small lists come at once; Python would search them for cycles again and again."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self.encode(chunks)
        finally:
            if on:
                gc.enable()

    def step(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, self.odd)
        if self.first:
            texts = pc.binary_join_element_wise(pa.scalar(self.first, pa.large_string()), texts, pa.scalar("", pa.large_string()))
        if pc.any(odd).as_py():
            strange = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            plain = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
            kind = pa.list_(pa.large_string())
            some = pa.array([self.cut_odd(t.as_py()) for t in texts.take(pa.array(strange))], kind)
            lists = pa.concat_arrays([cut_plain(texts.take(pa.array(plain)), self.points).cast(kind), some])
            lists = lists.take(pa.array(np.argsort(np.r_[plain, strange], kind="stable")))
        else:
            lists = cut_plain(texts, self.points)
        per_text = pc.list_value_length(lists).to_numpy().astype(np.int64)
        codes = lists.flatten().dictionary_encode()
        number = self.learn(codes.dictionary.to_pylist())[codes.indices.to_numpy()]
        sizes = self.sizes[number]
        ids = gather(self.flat, self.starts[number], sizes)
        row = np.repeat(np.arange(len(texts)), per_text)
        return ids, np.bincount(row, sizes, len(texts)).astype(np.int64)

    def __call__(self, texts: pa.Array):
        """(first row, end row, ids, ids per text) of consecutive parts of ``texts``."""
        for a, b in steps(pc.binary_length(texts).to_numpy(), self.step_bytes):
            yield a, b, *self.step(texts[a:b].cast(pa.large_string()))
        pa.default_memory_pool().release_unused()
