"""Wording of held-out test items inside corpus documents, found by spaced-seed hashing.

A seed is a fixed mask over consecutive words that ignores some positions, so that a seed still hits
where single words were replaced. The hashes of all test windows are joined with those of all corpus
windows; around every hit the two texts are compared word by word on their common diagonal.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.common import shelve

#: The seeds; 1 is a compared word, 0 an ignored one. Each spans fewer words than a leak.
SEEDS = ("111011001011011", "1101100111010111", "11101010011110111")
#: So many test words are held by a worker at once; more test items are joined with the corpus by the hashes of windows.
BLOCK_WORDS = 500_000
#: Bits, as a power of two, of the filter that corpus windows pass before they are shuffled for that join.
FILTER_BITS = 26
#: Slots of the table that most windows are ruled out by.
_SLOTS = 1 << 21
#: Documents of at most so many characters together are compared at once.
_CHUNK_CHARS = 4_000_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The maximal runs of letters and digits of any script, in lower case. Null and empty: none."""
    found = _WORD.findall(text or "")
    return " ".join(found).lower().split(" ") if found else []


class Block(NamedTuple):
    """Some test items: their words as numbers, and the hashes of all their seed windows, ascending per seed."""

    vocabulary: dict[str, int]
    codes: np.ndarray  # by word number; 0 is any word of no item
    item_ids: list
    text: np.ndarray  # word numbers of all items, one after the other
    starts: np.ndarray  # of each item in text; one more at the end
    keys: list[np.ndarray]
    places: list[np.ndarray]  # index into text of each key's window
    slots: list[np.ndarray]


def _window_hashes(codes: np.ndarray, seed: str) -> np.ndarray:
    """The hash of the window at every position; wraps around modulo 2**64."""
    n = max(0, len(codes) - len(seed) + 1)
    out = np.zeros(n, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for offset, bit in enumerate(seed):
        if bit == "1":
            out = out * factor + codes[offset : offset + n]
    out ^= out >> np.uint64(29)
    return out


def make_block(items: list[tuple], seeds: tuple[str, ...] = SEEDS) -> Block:
    """``items``: (id, words)."""
    vocabulary: dict[str, int] = {}
    numbers = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws], np.int64) for _, ws in items]
    text = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in numbers])]).astype(np.int64)
    codes = np.concatenate([[0], np.random.default_rng(7).integers(1, 2**63, len(vocabulary), np.uint64)]).astype(np.uint64)
    owner = np.repeat(np.arange(len(items)), np.diff(starts))
    keys, places, slots = [], [], []
    for seed in seeds:
        h = _window_hashes(codes[text], seed)
        whole = owner[: len(h)] == owner[len(seed) - 1 : len(seed) - 1 + len(h)]
        place = np.flatnonzero(whole)
        order = np.argsort(h[place], kind="stable")
        keys.append(h[place][order])
        places.append(place[order])
        slot = np.zeros(_SLOTS, bool)
        slot[keys[-1] & np.uint64(_SLOTS - 1)] = True
        slots.append(slot)
    return Block(vocabulary, codes, [i for i, _ in items], text, starts, keys, places, slots)


def blocks(items: Iterable[tuple], most: int = BLOCK_WORDS) -> Iterator[list[tuple]]:
    """Test items (id, text) in blocks of at most ``most`` words, but of one item at least."""
    held, size = [], 0
    for item_id, text in items:
        ws = words(text)
        if held and size + len(ws) > most:
            yield held
            held, size = [], 0
        held.append((item_id, ws))
        size += max(1, len(ws))
    if held:
        yield held


def _longest(equal: np.ndarray, wrong: int) -> int:
    """Words in the longest stretch of ``equal`` that begins and ends with equal words and holds at most ``wrong`` others."""
    at = np.flatnonzero(equal)
    if not len(at):
        return 0
    best = 0
    misses = np.concatenate([[-1], np.flatnonzero(~equal), [len(equal)]])
    for i in range(len(misses) - 1):
        j = min(i + wrong + 1, len(misses) - 1)
        inside = at[(at > misses[i]) & (at < misses[j])]
        if len(inside):
            best = max(best, int(inside[-1] - inside[0] + 1))
    return best


def overlaps(texts: list[str | None], block: Block, seeds: tuple[str, ...], substitutions: int) -> Iterator[tuple[int, int, int, int]]:
    """(index of text, index of item, longest exact overlap, longest overlap with substitutions), by diagonal."""
    get = block.vocabulary.get
    gap = np.zeros(max(map(len, seeds)), np.int64)
    parts, starts, ends, at = [], [], [], 0
    for t in texts:
        numbers = np.fromiter((get(w, 0) for w in words(t)), np.int64)
        parts += [numbers, gap]
        starts.append(at)
        ends.append(at + len(numbers))
        at += len(numbers) + len(gap)
    if not parts:
        return
    line = np.concatenate(parts)
    codes = block.codes[line]
    begin, end = np.array(starts), np.array(ends)
    diagonals: set[tuple[int, int, int]] = set()
    for seed, keys, places, slot in zip(seeds, block.keys, block.places, block.slots):
        h = _window_hashes(codes, seed)
        near = np.flatnonzero(slot[h & np.uint64(_SLOTS - 1)])
        low, high = np.searchsorted(keys, h[near], "left"), np.searchsorted(keys, h[near], "right")
        hit = high > low
        for p, a, b in zip(near[hit], low[hit], high[hit]):
            doc = int(np.searchsorted(begin, p, "right")) - 1
            for q in places[a:b]:
                item = int(np.searchsorted(block.starts, q, "right")) - 1
                diagonals.add((doc, item, int(p - q)))
    for doc, item, shift in sorted(diagonals):
        lo = max(block.starts[item], begin[doc] - shift)
        hi = min(block.starts[item + 1], end[doc] - shift)
        if hi > lo:
            equal = block.text[lo:hi] == line[lo + shift : hi + shift]
            yield doc, item, _longest(equal, 0), _longest(equal, substitutions)


def find_leaks(
    docs: DataFrame, items: DataFrame, *, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "item_text",
    min_words: int = 20, substitutions: int = 2, seeds: tuple[str, ...] = SEEDS, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Documents and the test items whose wording they hold.

    Result: ``doc_key``, ``item_key``, exact_words, similar_words; a row per pair that shares, in order
    and without another word between, at least ``min_words`` words, where up to ``substitutions`` of them
    may be replaced. exact_words is the longest such stretch without a replaced word, similar_words the
    longest with up to that many. Every stretch of ``min_words`` equal words is found, as each seed spans
    at most that many; replaced words are found wherever a seed fits around them. Words are runs of
    letters and digits in lower case. Null and empty texts hold nothing; repeated documents fold
    together; other columns are ignored.

    Up to ``block_words`` test words are held by every worker: no corpus row is shuffled, only leaks are. More
    test items are joined instead: the hashes of all their windows with those of the corpus windows that pass a filter
    of fixed size; texts in which a window hits meet the item's. The result is the same, and either way the corpus is
    read a fixed number of times.
    """
    if min_words < max(map(len, seeds)):
        raise ValueError("a seed must not span more than min_words")
    spark = docs.sparkSession
    corpus = docs.select(F.col(doc_key), F.col(text).cast("string").alias("text"))
    tests = items.select(item_key, F.col(item_text).cast("string").alias("item_text")).where(F.col(item_text).isNotNull()).distinct()
    stream = blocks(((r[0], r[1]) for r in tests.toLocalIterator()), block_words)
    held = next(stream, None)
    if held is not None and next(stream, None) is not None:
        return _joined_leaks(corpus, tests, doc_key, item_key, min_words, substitutions, seeds)
    if held is None:
        return spark.createDataFrame([], f"`{doc_key}` {docs.schema[doc_key].dataType.simpleString()}, `{item_key}` {items.schema[item_key].dataType.simpleString()}, exact_words int, similar_words int")
    shared = spark.sparkContext.broadcast(make_block(held, seeds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in _chunks(texts):
                rows = [r for r in overlaps(texts[lo:hi], shared.value, seeds, substitutions) if r[3] >= min_words]
                if rows:
                    doc, *rest = zip(*rows)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array([lo + d for d in doc])), *(pa.array(x, pa.int32()) for x in rest)], [doc_key, "item", "exact_words", "similar_words"])

    kinds = f"`{doc_key}` {docs.schema[doc_key].dataType.simpleString()}, item int, exact_words int, similar_words int"
    ids = spark.createDataFrame(pd.DataFrame({"item": range(len(held)), item_key: [i for i, _ in held]}), f"item int, `{item_key}` {items.schema[item_key].dataType.simpleString()}")
    found = corpus.mapInArrow(run, kinds).join(F.broadcast(ids), "item").drop("item")
    return _longest_of(found, doc_key, item_key)


def _longest_of(found: DataFrame, doc_key: str, item_key: str) -> DataFrame:
    return found.groupBy(doc_key, item_key).agg(F.max("exact_words").alias("exact_words"), F.max("similar_words").alias("similar_words"))


def _seed_hashes(text: str | None, seeds: tuple[str, ...]) -> Iterator[np.ndarray]:
    """Per seed, the hashes of a text's windows, the same on every worker; seeds have hashes of their own."""
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words(text)), np.uint64)
    for s, seed in enumerate(seeds):
        yield _window_hashes(codes, seed) * np.uint64(2 * s + 1) + np.uint64(s)


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each hash."""
    mask = np.uint64((1 << FILTER_BITS) - 1)
    mixed = h * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(34)) & mask, (mixed >> np.uint64(3)) & mask


def _window_rows(texts: DataFrame, seeds: tuple[str, ...], bits=None) -> DataFrame:
    """id, h, at: the windows of ``texts`` (id, text) by the seed's hash; those only that pass ``bits`` (a broadcast filter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _chunks(batch.column(1).to_pylist()):
                ids, hashes, places = [], [], []
                for k, text in zip(batch.column(0).to_pylist()[lo:hi], batch.column(1).to_pylist()[lo:hi]):
                    for h in _seed_hashes(text, seeds):
                        at = np.arange(len(h))
                        if bits is not None:
                            a, b = _places(h)
                            held = bits.value
                            at = np.flatnonzero((held[a >> np.uint64(3)] >> (a & np.uint64(7)) & 1) & (held[b >> np.uint64(3)] >> (b & np.uint64(7)) & 1))
                        ids.append(np.full(len(at), k, np.int64))
                        hashes.append(h[at].view(np.int64))
                        places.append(at)
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(places).astype(np.int32))], ["id", "h", "at"])

    return texts.mapInArrow(run, "id long, h long, at int")


def _filter_of(tests: DataFrame, seeds: tuple[str, ...]) -> np.ndarray:
    """The packed bits that the windows of all test items set. Tasks send filters of one fixed size, 32 of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for h in _seed_hashes(text, seeds):
                    for a in _places(h):
                        np.bitwise_or.at(bits, a >> np.uint64(3), np.left_shift(np.uint8(1), (a & np.uint64(7)).astype(np.uint8)))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in tests.select("item_text").coalesce(32).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r[0], np.uint8)
    return out


def _joined_leaks(corpus: DataFrame, tests: DataFrame, doc_key: str, item_key: str, min_words: int, substitutions: int, seeds: tuple[str, ...]) -> DataFrame:
    """``find_leaks`` by a join of windows. Texts are told apart by a hash of key and text."""
    spark = corpus.sparkSession
    d = corpus.select(F.xxhash64(F.col(doc_key), F.lit(0), "text").alias("id"), "text", F.col(doc_key).alias("_doc"))
    t = shelve(tests.select(F.xxhash64(F.col(item_key), F.lit(1), "item_text").alias("item"), "item_text", F.col(item_key).alias("_item")), "tests")
    bits = spark.sparkContext.broadcast(_filter_of(t, seeds))
    left = _window_rows(d.select("id", "text"), seeds, bits)
    right = _window_rows(t.select(F.col("item").alias("id"), F.col("item_text").alias("text")), seeds).select("h", F.col("id").alias("item"), F.col("at").alias("item_at"))
    hits = left.join(right, "h").select("id", "item", (F.col("at") - F.col("item_at")).alias("shift")).groupBy("id", "item").agg(F.collect_set("shift").alias("shifts"))
    texts = d.join(hits.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    pairs = hits.join(texts, "id").join(t, "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact, similar = [], []
            for shifts, text, item_text in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                a, b = words(text), words(item_text)
                best = [0, 0]
                for shift in shifts:
                    lo, hi = max(0, -shift), min(len(b), len(a) - shift)
                    equal = np.fromiter((a[i + shift] == b[i] for i in range(lo, hi)), bool)
                    best = [max(best[0], _longest(equal, 0)), max(best[1], _longest(equal, substitutions))]
                exact.append(best[0])
                similar.append(best[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(exact, pa.int32()), pa.array(similar, pa.int32())], [doc_key, item_key, "exact_words", "similar_words"])

    kinds = f"`{doc_key}` {corpus.schema[doc_key].dataType.simpleString()}, `{item_key}` {tests.schema[item_key].dataType.simpleString()}, exact_words int, similar_words int"
    checked = pairs.select("_doc", "_item", "shifts", "text", "item_text").mapInArrow(run, kinds)
    return _longest_of(checked.where(F.col("similar_words") >= min_words), doc_key, item_key)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _CHUNK_CHARS:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
