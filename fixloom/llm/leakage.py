"""Evaluation texts, or stretches of them, that a corpus contains."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE, RATE = 30, 0.1
WINDOW, WALKS, TABLES, SAMPLED = 20, 8, 6, 7
_TAG = re.compile(r"</?[A-Za-z!][^<>]{0,200}>")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\[nrtfb]|\\(?=[\"'/\\])")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐­]\s*\n[>\s]*(?=[^\W\d_])")
_INVISIBLE = re.compile("[­​-‍⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def _unescape(m: re.Match) -> str:
    code = m.group(1) or m.group(2)
    return chr(int(code, 16)) if code else " "


def words(text: str) -> list[str]:
    """The words of a text in lower case, whatever its markup, escapes, line breaks, hyphenation and punctuation."""
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "%" in text:
        text = _PERCENT.sub(lambda m: bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "replace"), text)
    for _ in range(2):
        if "<" in text:
            text = _TAG.sub("", text) if "><" not in text else _TAG.sub("", text.replace("><", "> <"))
        if "&" not in text:
            break
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    text = _BROKEN.sub("", text)
    return _WORD.findall(_INVISIBLE.sub("", text).lower() if not text.isascii() else text.lower())


class Index:
    """Hash tables over all windows of the items; made once in each Python worker from the items' words."""

    def __init__(self, items: list[tuple[int, list[str]]], seed: int = 11):
        self.items = items
        self.ids: dict[str, int] = {}
        self.coded = [np.fromiter((self.ids.setdefault(w, len(self.ids) + 1) for w in ws), np.int64, len(ws)) for _, ws in items]
        random = np.random.default_rng(seed)
        self.steps = random.integers(0, 2, (WALKS, 3 * WINDOW, len(self.ids) + 1), dtype=np.int8)
        self.samples = np.stack([[random.choice(2 * WINDOW, SAMPLED, replace=False) for _ in range(TABLES)] for _ in range(WALKS)])
        self.mix = random.integers(1, 2**62, (WALKS, TABLES, SAMPLED), dtype=np.int64) | 1
        where = [(k, q) for k, c in enumerate(self.coded) for q in range(max(len(c) - WINDOW + 1, 0))]
        self.where = np.array(where, np.int64).reshape(-1, 2)
        rows = np.stack([self.coded[k][q : q + WINDOW] for k, q in where]) if where else np.zeros((0, WINDOW), np.int64)
        self.tables = []
        for keys in self.keys(rows):
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], order))

    def keys(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """CGK: each walk reads a window, repeating or advancing by a random bit of (step, word); then sampled symbols."""
        n = len(rows)
        padded = np.concatenate([rows, np.full((n, 1), -1, np.int64)], axis=1)
        at = np.arange(n)
        for w in range(WALKS):
            i = np.zeros(n, np.int64)
            out = np.empty((2 * WINDOW, n), np.int64)
            for j in range(2 * WINDOW):
                symbol = padded[at, i]
                out[j] = symbol
                i = np.minimum(i + np.where(symbol >= 0, self.steps[w, j, np.maximum(symbol, 0)], 0), WINDOW)
            for t in range(TABLES):
                with np.errstate(over="ignore"):
                    yield ((out[self.samples[w, t]] + 2) * self.mix[w, t][:, None]).sum(axis=0) ^ (w * TABLES + t)

    def candidates(self, rows: np.ndarray) -> np.ndarray:
        """Pairs (row, item window) that agree in a table."""
        found = []
        for (table, order), keys in zip(self.tables, self.keys(rows), strict=True):
            left, right = np.searchsorted(table, keys, "left"), np.searchsorted(table, keys, "right")
            n = right - left
            if n.sum():
                row = np.repeat(np.arange(len(keys)), n)
                slot = np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                found.append(row * len(order) + order[slot])
        if not found:
            return np.zeros((0, 2), np.int64)
        pairs = np.unique(np.concatenate(found))
        return np.stack([pairs // len(self.where), pairs % len(self.where)], axis=1)


def _cheapest(item: np.ndarray, text: np.ndarray) -> bool:
    """Exact: some 30 words or more in a row of the item, first and last unaltered, at most one edit in ten.

    Edit distance with free ends in the text, for all starts at once. Lengths up to 75 are tried, as of a longer
    passage a part of that length fits as well.
    """
    n, m, far = len(item), len(text), np.int32(10_000)
    starts = np.arange(n - PASSAGE + 1)
    if not len(starts) or not m:
        return False
    cost = np.zeros((len(starts), m + 1), np.int32)
    ramp = np.arange(m + 1, dtype=np.int32)
    for k in range(1, 76):
        live = starts + k <= n
        if not live.any():
            break
        same = item[np.minimum(starts + k - 1, n - 1)][:, None] == text[None, :]
        ends = np.where(same, cost[:, :-1], far)
        if k >= PASSAGE and (ends.min(axis=1)[live] <= k * RATE).any():
            return True
        new = np.full_like(cost, far)
        if k == 1:
            new[:, 1:] = ends
        else:
            new[:, 1:] = np.minimum(cost[:, :-1] + ~same, cost[:, 1:] + 1)
        cost = np.minimum.accumulate(new - ramp, axis=1) + ramp
        if (cost.min(axis=1)[live] > 8).all():
            return False
    return False


@lru_cache(maxsize=256)
def _spans(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n + 1, PASSAGE)


def contains(item: np.ndarray, text: np.ndarray) -> bool:
    """Whether ``text`` has a passage of the item.

    Words of the item that the text lacks cost an edit each, so a span with too many of them is no passage, and if no
    span is left there is none. Then one alignment, and unless that shows a passage already, all of them.
    """
    n = len(item)
    if n < PASSAGE or not len(text):
        return False
    i, j = _spans(n)
    room = (j - i) * RATE
    absent = np.concatenate([[0], np.cumsum(~np.isin(item, text))])
    if not (absent[j] - absent[i] <= room).any():
        return False
    missing, extra = np.ones(n, np.int64), np.zeros(n + 1, np.int64)
    last_i = last_t = 0
    for at, t, size in SequenceMatcher(None, item.tolist(), text.tolist(), autojunk=False).get_matching_blocks():
        if size and at:
            extra[at] += max((t - last_t) - (at - last_i), 0) if last_i else 0
        missing[at : at + size] = 0
        last_i, last_t = at + size, t + size
    lost, added = np.concatenate([[0], np.cumsum(missing)]), np.cumsum(extra)
    whole = (missing[i] == 0) & (missing[j - 1] == 0)  # a passage begins and ends with a word of the item
    cost = lost[j] - lost[i] + added[np.maximum(j - 1, 0)] - added[i]
    return bool((whole & (cost <= room)).any()) or _cheapest(item, text)


def _near(index: Index, pairs: np.ndarray, coded: list[np.ndarray], owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which (window, item window) pairs share enough words, those around the window in the text included."""
    spare = int(PASSAGE * RATE)
    edge = WINDOW + 2 * spare
    text = np.concatenate([np.concatenate([np.full(spare, -1), coded[d], np.full(edge, -1)]) for d in range(len(coded))])
    start = np.concatenate([[0], np.cumsum([len(c) + spare + edge for c in coded])[:-1]])
    out = np.empty(len(pairs), bool)
    words_of = np.concatenate([*index.coded, np.zeros(1, np.int64)])
    begin = np.concatenate([[0], np.cumsum([len(c) for c in index.coded])])
    for a in range(0, len(pairs), 20_000):
        r, w = pairs[a : a + 20_000].T
        around = text[(start[owner[r]] + place[r])[:, None] + np.arange(edge)]
        k, q = index.where[w].T
        mine = words_of[(begin[k] + q)[:, None] + np.arange(WINDOW)]
        out[a : a + 20_000] = (mine[:, :, None] == around[:, None, :]).any(axis=2).sum(axis=1) >= WINDOW - spare
    return out


def _find(index: Index, coded: list[np.ndarray]) -> list[tuple[int, int]]:
    """(position in ``coded``, item) pairs: prune, hash windows, verify."""
    spare = int(PASSAGE * RATE)
    rows, owner, place = [], [], []
    for d, c in enumerate(coded):
        if len(c) < WINDOW:
            continue
        known = np.concatenate([[0], np.cumsum(c > 0)])
        at = np.flatnonzero(known[WINDOW:] - known[:-WINDOW] >= WINDOW - spare)
        if len(at):
            rows.append(np.lib.stride_tricks.sliding_window_view(c, WINDOW)[at])
            owner.append(np.full(len(at), d))
            place.append(at)
    if not rows:
        return []
    rows, owner, place = np.concatenate(rows), np.concatenate(owner), np.concatenate(place)
    hits: set[tuple[int, int]] = set()
    marks = []
    for begin in range(0, len(rows), 100_000):
        pairs = index.candidates(rows[begin : begin + 100_000])
        pairs[:, 0] += begin
        pairs = pairs[_near(index, pairs, coded, owner, place)] if len(pairs) else pairs
        k, q = index.where[pairs[:, 1]].T if len(pairs) else np.zeros((2, 0), np.int64)
        p = place[pairs[:, 0]]
        # Windows of one mark lie up to 15 words apart, and a passage of up to 75 words drifts by 7 and is 7 longer.
        marks.append(np.stack([owner[pairs[:, 0]], k, (p - q) // 16, p - q], axis=1))
    found = np.concatenate(marks)
    _, first = np.unique(found[:, :3], axis=0, return_index=True)
    for d, k, _, shift in found[np.sort(first)].tolist():
        item, slack = index.coded[k], 32
        if (d, k) not in hits and contains(item, coded[d][max(shift - slack, 0) : shift + len(item) + slack]):
            hits.add((d, k))
    return sorted(hits)


def _search(items: list[tuple[int, list[str]]]):
    made: list[Index] = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not made:
            made.append(Index(items))
        index, ids = made[0], made[0].ids
        for batch in batches:
            coded = []
            for text in batch["text"]:
                ws = words(text)
                coded.append(np.fromiter((ids.get(w, 0) for w in ws), np.int64, len(ws)))
            pairs = _find(index, coded)
            doc = batch["doc_id"].to_numpy()
            yield pd.DataFrame({"doc_id": [doc[d] for d, _ in pairs], "item_id": [index.items[k][0] for _, k in pairs]}, columns=["doc_id", "item_id"])

    return run


def leaked_items(documents: DataFrame, items: DataFrame, block: int = 2_000) -> DataFrame:
    """``doc_id, item_id``: each document with at least 30 words in a row of an item, one in ten edited at most.

    A passage begins and ends with a word of the item, so a quotation of 28 words is none.

    The items are the query set: a table of fixed size, read in blocks of ``block`` items (in order of ``item_id``)
    so that no task holds more; every block is searched in all documents. In each document only windows that share
    enough words with the items go on, which loses no passage; these are embedded by CGK random walks (edits become
    substitutions), hashed on sampled symbols in several tables, and every agreeing pair is verified by alignment
    and, where that comes near, by exact edit distance. Documents are read once per block, in place, without a
    shuffle; whole texts, so the longest text bounds a task. Copies of documents each come out; repeated rows of a
    document come out once. NULL and empty texts, rows without ``doc_id``,
    and items under 30 words give nothing.
    """
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").orderBy("item_id", "text")
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length("text") >= 2 * PASSAGE)).select("doc_id", "text")
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}"
    out, taken = None, []
    for r in rows.toLocalIterator():
        taken.append((r["item_id"], words(r["text"])))
        if len(taken) == block:
            part = texts.mapInPandas(_search(taken), schema)
            out, taken = part if out is None else out.unionByName(part), []
    if taken or out is None:
        part = texts.mapInPandas(_search(taken), schema)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, n_documents`` of the items that leaked."""
    return leaked_items(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
