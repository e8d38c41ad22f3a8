"""Evaluation texts leaking into training text.

The n-grams of the normalised test passages form a hash set that is broadcast. Each task
slides a token window over its documents, keeps the hits, and verifies them: runs of equal
words between document and passage are chained in order, and a pair is a leak if the
chained words make up at least half of the passage. The spans can be cut out of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescan.sources.tables import table

#: Words of an n-gram, the least length of a run that counts, and the share that makes a leak.
NGRAM, RUN, SHARE = 5, 3, 0.5
#: Words that a further piece of a passage must cover to count.
PIECE = 8
#: Test passages per broadcast set. More items than this are scanned in several sets, so the broadcast stays bounded.
ITEMS_PER_SET = 20_000

WORD = re.compile(r"[^\W_]+")
MARKUP = re.compile(r"<[^<>\n]{1,80}>|&(?:[a-z]{2,8}|#\d{1,6});")
HYPHEN = re.compile(r"(?<=[a-z])-[ \t]*\r?\n[ \t>*#|]*(?=[a-z])")

FOUND = "doc_id bigint, item_id bigint, share double, starts array<int>, ends array<int>"


def blank_markup(text: str) -> str:
    """Same length, with tags, entities and hyphens at line ends blanked."""
    text = MARKUP.sub(lambda m: " " * len(m[0]), text)
    return HYPHEN.sub(lambda m: "\x00" * len(m[0]), text)


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-case words and their character spans."""
    clean = blank_markup(text)
    words, spans = [], []
    last = None
    for m in WORD.finditer(clean):
        w = m[0].lower()
        if last is not None and clean[last[1] : m.start()].strip("\x00") == "" and "\x00" in clean[last[1] : m.start()]:
            words[-1] += w
            spans[-1] = (spans[-1][0], m.end())
        else:
            words.append(w)
            spans.append(m.span())
        last = spans[-1]
    return words, spans


def passage_words(item_text: str | None, instruction: str | None) -> list[str]:
    """Words of the passage: the text without the instruction it begins with. Null: none."""
    text = item_text or ""
    if instruction and text.startswith(instruction):
        text = text[len(instruction) :]
    return words_of(text)[0]


def roll(ids: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each window of ``n`` word numbers; 0 where a word is unknown (-1)."""
    if len(ids) < n:
        return np.zeros(0, dtype=np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    known = np.ones(len(out), dtype=bool)
    for k in range(n):
        part = slice(k, k + len(out))
        out = out * np.uint64(0x100000001B3) + mixed[part]
        known &= ids[part] >= 0
    out[~known] = 0
    return out


def chain(doc: np.ndarray, passage: np.ndarray, run: int = RUN) -> list[tuple[int, int, int]]:
    """Runs (document position, passage position, length) in the order of both that cover most passage words."""
    where: dict[tuple, list[int]] = {}
    for j in range(len(passage) - run + 1):
        where.setdefault(tuple(passage[j : j + run]), []).append(j)
    runs: list[tuple[int, int, int]] = []
    open_: dict[int, list[int]] = {}
    for i in range(len(doc) - run + 1):
        now: dict[int, list[int]] = {}
        for j in where.get(tuple(doc[i : i + run]), ()):
            d = i - j
            if d in open_:
                r = open_[d]
                r[2] += 1
            else:
                r = [i, j, run]
                runs.append(r)  # type: ignore[arg-type]
            now[d] = r
        open_ = now
    runs.sort()
    best = [r[2] for r in runs]
    back = [-1] * len(runs)
    for b, (i, j, n) in enumerate(runs):
        for a in range(b):
            ai, aj, an = runs[a]
            over = max(0, ai + an - i, aj + an - j)
            if ai < i and aj < j and over < n and best[a] + n - over > best[b]:
                best[b], back[b] = best[a] + n - over, a
    out = []
    k = int(np.argmax(best)) if runs else -1
    while k >= 0:
        out.append(tuple(runs[k]))
        k = back[k]
    return out[::-1]


def pieces(doc: np.ndarray, passage: np.ndarray, least: int = PIECE) -> tuple[list[tuple[int, int, int]], int]:
    """Runs of the best chain, then of the best chain among the passage words still uncovered, and so on.

    So a passage whose parts stand in another order is found part by part. A further piece
    counts if it covers at least ``least`` words. Returns the runs and the words covered.
    """
    left = passage.copy()
    used: list[tuple[int, int, int]] = []
    seen: set[int] = set()
    while True:
        runs = chain(doc, left)
        new = {k for _, j, n in runs for k in range(j, j + n)}
        if not new or used and len(new) < least:
            return used, len(seen)
        used += runs
        seen |= new
        left[list(new)] = -2 - np.array(sorted(new))


class PassageIndex:
    """The broadcast side: word numbers, n-gram hashes and the passages they come from."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        vocabulary = sorted({w for _, ws in items for w in ws})
        self.number = {w: k for k, w in enumerate(vocabulary)}
        self.items = [(i, np.array([self.number[w] for w in ws], dtype=np.int64)) for i, ws in items]
        pairs = [(h, k) for k, (_, ids) in enumerate(self.items) for h in set(roll(ids, NGRAM).tolist())]
        pairs.sort()
        self.hashes = np.array([h for h, _ in pairs], dtype=np.uint64)
        self.owner = np.array([k for _, k in pairs], dtype=np.int64)

    def leaks(self, text: str) -> list[tuple[int, float, list[int], list[int]]]:
        """(item_id, share, span starts, span ends) of each item that stands in ``text``."""
        words, spans = words_of(text)
        ids = np.fromiter((self.number.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        grams = roll(ids, NGRAM)
        lo, hi = np.searchsorted(self.hashes, grams, "left"), np.searchsorted(self.hashes, grams, "right")
        found = np.flatnonzero((hi > lo) & (grams != 0))
        if not len(found):
            return []
        owners = np.unique(np.concatenate([self.owner[lo[k] : hi[k]] for k in found]))
        out = []
        for k in owners:
            item, passage = self.items[k]
            # No chain can cover more than the words the document has at all.
            if np.isin(passage, ids).sum() < SHARE * len(passage):
                continue
            runs, count = pieces(ids, passage)
            share = count / len(passage)
            if share >= SHARE:
                out.append((item, share, [spans[i][0] for i, _, _ in runs], [spans[i + n - 1][1] for i, _, n in runs]))
        return out


def find_leaks(docs: DataFrame, items: DataFrame, items_per_set: int = ITEMS_PER_SET) -> DataFrame:
    """(doc_id, item_id, share, starts, ends) of every document that holds at least half of a passage.

    ``docs``: doc_id, text. ``items``: item_id, item_text, instruction. A null or blank
    text or passage is never part of a leak, and a passage must cover at least one n-gram of ``NGRAM`` words. The test set is
    collected in sets of at most ``items_per_set`` items; each is broadcast and scanned
    against all documents.
    """
    spark = docs.sparkSession
    sets = max(1, -(-items.count() // items_per_set))
    part = F.pmod(F.xxhash64("item_id"), F.lit(sets))
    out = None
    for k in range(sets):
        rows = items.filter(part == k).select("item_id", "item_text", "instruction").collect()
        index = spark.sparkContext.broadcast(PassageIndex([(r[0], passage_words(r[1], r[2])) for r in rows]))

        def scan(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            found = index.value
            for pdf in batches:
                yield pd.DataFrame(
                    [(d, *leak) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) if t for leak in found.leaks(t)],
                    columns=["doc_id", "item_id", "share", "starts", "ends"],
                )

        hits = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).mapInPandas(scan, FOUND)
        out = hits if out is None else out.unionByName(hits)
    return out


def remove_spans(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """Documents with the leaked spans cut out: doc_id, text, removed_chars (0 if untouched)."""
    spans = leaks.groupBy("doc_id").agg(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, parts in zip(pdf["doc_id"], pdf["text"], pdf["spans"], strict=True):
                if text is None or parts is None or not len(parts):
                    rows.append((doc, text, 0))
                    continue
                kept, at = [], 0
                for a, b in sorted((p["starts"], p["ends"]) for p in parts):
                    kept.append(text[at : max(at, a)])
                    at = max(at, b)
                new = "".join(kept) + text[at:]
                rows.append((doc, new, len(text) - len(new)))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "removed_chars"])

    return docs.select("doc_id", "text").join(spans, "doc_id", "left").mapInPandas(cut, "doc_id bigint, text string, removed_chars int")


def spread(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table whose few files would give few tasks, dealt out evenly for work in Python."""
    df = table(spark, sf_dir, name).select(*columns)
    want = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def document_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spread(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items"))
