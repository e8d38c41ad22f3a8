"""Per-document text quality and the shape of its lines.

Every line is labelled prose, list, table or junk by a hidden Markov model over line
statistics: counts of words, marks, fields and sentence ends, lengths, repeats, and how well
the letters follow each other by the letter pairs of the whole store, and which of its words the store
uses in sentences. No word list of any language is used. The model starts from the counts of plain cases among the documents of
``SEED_SHARE`` and is then fitted by expectation maximisation over all documents, where the
plain cases play no part any more; they are no input of the model either. Counts are summed by
Spark; only the small tables of the model reach the driver.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescan.llm.leakage import spread
from tidescan.session import materialise
from tidescan.sources.tables import table

STATES = ["prose", "list", "table", "junk"]
PROSE, LIST, TABLE, JUNK = range(4)

#: The statistics of a line and how many values each takes.
FEATURES = {
    "words": 28, "start": 18, "fields": 5, "letters": 4, "odd": 3, "pairs": 4, "repeat": 3, "end": 3, "near": 3, "width": 4, "short": 4, "case": 3, "commas": 2, "lexicon": 7,
}
NAMES = list(FEATURES)
SIZES = np.array(list(FEATURES.values()))
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)[:-1]])
WIDTH = int(SIZES.sum())
#: Weight of the smoothing counts, rounds of expectation maximisation, share of documents whose plain cases start the fit.
SMOOTH, ROUNDS, SEED_SHARE = 2.0, 2, 0.5
#: Characters handled at once, and documents decoded at once.
CHUNK_CHARS, CHUNK_DOCS = 400_000, 256
#: Words are counted in so many hashed cells, by whether they stand in paragraphs with sentences or not.
CELLS = 1 << 16
#: Symbols that letters are folded to for the statistics of letter pairs.
SYMBOLS = 64

SPACE, LOWER, UPPER, LETTER, DIGIT, OTHER = range(6)
_BULLETS, _ENDERS, _COMMAS = "-*•+–‣▪◦", ".!?…。！？।؟", ",;、،"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, lower-case form and pair symbol of each code point of the basic plane; one row more for all others."""
    kind = np.full(65_537, OTHER, dtype=np.uint8)
    low = np.arange(65_537, dtype=np.uint32)
    for c in range(65_536):
        ch, cat = chr(c), unicodedata.category(chr(c))
        if ch.isspace() or cat[0] == "Z":
            kind[c] = SPACE
        elif cat in ("Lu", "Lt"):
            kind[c], low[c] = UPPER, ord(ch.lower()[0])
        elif cat == "Ll":
            kind[c] = LOWER
        elif cat[0] in "LM":
            kind[c] = LETTER
        elif cat == "Nd":
            kind[c] = DIGIT
    kind[65_536] = LETTER
    pair = np.where((low >= 97) & (low <= 122), low - 97, 26 + low % (SYMBOLS - 26)).astype(np.uint8)
    return kind, low, pair


_TABLES: list = []


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES.append(_tables())
    return _TABLES[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, each text ended by a line break; and where each text begins."""
    plain = [t.replace("\r\n", "\n").replace("\r", "\n") + "\n" for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in plain])])
    return np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts


def letter_pairs(texts: list[str]) -> np.ndarray:
    """Counts of neighbouring letters, by symbol."""
    kinds, _, pair = tables()
    cps, _ = code_points(texts)
    at = np.minimum(cps, 65_536)
    kind = kinds[at]
    letter = (kind >= LOWER) & (kind <= UPPER)  # scripts without case write words too differently
    both = letter[:-1] & letter[1:]
    s = pair[at].astype(np.int64)
    return np.bincount((s[:-1] * SYMBOLS + s[1:])[both], minlength=SYMBOLS * SYMBOLS)


def pair_scores(counts: np.ndarray) -> np.ndarray:
    """How much likelier than by chance each pair is (log 2)."""
    c = counts.reshape(SYMBOLS, SYMBOLS) + 0.5
    p = c / c.sum()
    return np.log2(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True))).ravel()


def bins(x: np.ndarray, *edges: float) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, side="left")


def line_features(texts: list[str], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the non-blank lines of all texts: the text's number, the trimmed length, the values of FEATURES (the last one open),
    the number of words, and the cells of all words."""
    kinds, lows, symbol = tables()
    cps, doc_at = code_points(texts)
    at = np.minimum(cps, 65_536)
    kind = kinds[at]
    n = len(cps)
    breaks = np.flatnonzero(cps == 10)
    begin = np.concatenate([[0], breaks[:-1] + 1])
    solid = np.flatnonzero(kind != SPACE)
    a, b = np.searchsorted(solid, begin), np.searchsorted(solid, breaks)
    full = b > a
    blank_before = np.concatenate([[True], ~full[:-1]])[full]  # a paragraph begins
    begin, ends, a, b = begin[full], breaks[full], a[full], b[full]
    m = len(begin)
    doc = np.searchsorted(doc_at, begin, side="right") - 1
    if not m:
        return doc, np.zeros(0, dtype=np.int64), np.zeros((0, len(SIZES)), dtype=np.uint8), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint16)
    first, last = solid[a], solid[b - 1]
    size = last - first + 1
    before, after = np.concatenate([[10], cps[:-1]]), np.concatenate([cps[1:], [10]])
    kind_before, kind_after = np.concatenate([[SPACE], kind[:-1]]), np.concatenate([kind[1:], [SPACE]])
    inside = np.zeros(n + 1, dtype=np.int32)
    np.add.at(inside, first, 1)
    np.add.at(inside, last + 1, -1)
    inside = np.cumsum(inside[:-1]).astype(bool)  # within a trimmed line

    def per_line(mask: np.ndarray) -> np.ndarray:
        where = np.flatnonzero(mask)
        return np.searchsorted(where, ends) - np.searchsorted(where, begin)

    def any_of(chars: str, x: np.ndarray = cps) -> np.ndarray:
        out = np.zeros(n, dtype=bool)
        for c in chars:
            out |= x == ord(c)
        return out

    letter = (kind >= LOWER) & (kind <= LETTER)
    head = letter & ~((kind_before >= LOWER) & (kind_before <= LETTER))
    word_at = np.flatnonzero(head)
    tail_at = np.flatnonzero(letter & ~((kind_after >= LOWER) & (kind_after <= LETTER)))
    word_len = tail_at - word_at + 1
    w0, w1 = np.searchsorted(word_at, begin), np.searchsorted(word_at, ends)
    words = w1 - w0
    upto = lambda x: np.concatenate([[0], np.cumsum(x)])
    short = upto(word_len <= 3)
    short = np.where(words > 2, (short[w1] - short[w0]) / np.maximum(words, 1), 0.0)

    # Words by a hash of their lower-case letters, for repeats.
    where = np.flatnonzero(letter)
    nth = where - np.repeat(word_at, word_len)
    mixed = (lows[at[where]].astype(np.uint64) + np.uint64(7)) * (np.uint64(0x9E3779B97F4A7C15) ^ (nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    mixed ^= mixed >> np.uint64(31)
    hashed = np.add.reduceat(mixed, np.concatenate([[0], np.cumsum(word_len)[:-1]])) if len(where) else np.zeros(0, dtype=np.uint64)
    line_of_word = np.repeat(np.arange(m), words)
    in_lines = hashed[np.repeat(w0 - upto(words)[:-1], words) + np.arange(len(line_of_word))] if len(line_of_word) else hashed[:0]
    order = np.lexsort((in_lines, line_of_word))
    ol, oh = line_of_word[order], in_lines[order]
    new = np.concatenate([[True], (ol[1:] != ol[:-1]) | (oh[1:] != oh[:-1])]) if len(ol) else np.zeros(0, dtype=bool)
    distinct = np.bincount(ol[new], minlength=m) / np.maximum(words, 1)

    # Tokens: runs without blanks.
    token_head = (kind != SPACE) & (kind_before == SPACE)
    t_at = np.flatnonzero(token_head)
    t_end = np.flatnonzero((kind != SPACE) & (kind_after == SPACE)) + 1
    t_len = t_end - t_at
    hexes = (kind == DIGIT) | ((lows[at] >= 97) & (lows[at] <= 102))
    plain = ((cps < 128) & (letter | (kind == DIGIT))) | any_of("+/=_%\\-")
    of_tokens = lambda mask: (lambda c: c[t_end] - c[t_at])(upto(mask))
    t_hex, t_plain, t_digit, t_pct, t_letter, t_strange = of_tokens(hexes), of_tokens(plain), of_tokens(kind == DIGIT), of_tokens(any_of("%\\")), of_tokens(letter), of_tokens((kind == OTHER) & (cps > 126))
    all_hex = t_hex == t_len
    odd = (t_len >= 24) & (t_plain == t_len) | all_hex & (t_len >= 8) & (t_digit > 0) & (t_digit < t_len) | (t_pct * 3 >= 0.8 * t_len) & (t_len >= 6) | (t_strange > 0) & (t_letter <= 4 * t_strange)
    t0, t1 = np.searchsorted(t_at, begin), np.searchsorted(t_at, ends)
    total = lambda x: (lambda c: c[t1] - c[t0])(upto(x))
    bytes_ = total(all_hex & (t_len == 2) & (t_digit + t_letter == 2))
    odd_chars = total(np.where(odd, t_len, 0)) + np.where(bytes_ >= 6, 3 * bytes_, 0)

    # Letter pairs.
    both = (kind >= LOWER) & (kind <= UPPER) & (kind_after >= LOWER) & (kind_after <= UPPER)
    pair_at = np.flatnonzero(both)
    sym = symbol[at].astype(np.int64)
    score = upto(pairs[sym[pair_at] * SYMBOLS + sym[np.minimum(pair_at + 1, n - 1)]])
    p0, p1 = np.searchsorted(pair_at, begin), np.searchsorted(pair_at, ends)
    fit = np.where(p1 - p0 >= 12, (score[p1] - score[p0]) / np.maximum(p1 - p0, 1), 0.75)

    # Fields.
    comma = cps == 44
    pipes, tabs, semis = per_line(cps == 124), per_line((cps == 9) & inside), per_line(cps == 59)
    quoted = per_line(comma & (before == 34) & (after == 34))
    two = np.concatenate([cps[2:], [10, 10]])
    tag = (cps == 60) & ((after == 116) & any_of("dhra", two) | (after == 47) & (two == 116))
    cells = per_line(tag)
    tight = per_line(comma & (kind_before != SPACE) & (kind_after != SPACE))
    gaps = per_line((kind == SPACE) & (kind_before != SPACE) & (kind_after == SPACE) & inside & (cps != 9)) + tabs
    marks = np.maximum.reduce([pipes, tabs, np.where(words < 25, semis, 0), quoted])
    fields = np.where(cells >= 2, 4, np.where((marks >= 2) | (tight >= 3), 3, np.where(gaps >= 2, 2, np.where((marks > 0) | (tight > 0) | (gaps > 0), 1, 0))))

    # Sentence ends: a mark after a word (or its closing quote or bracket) and before a blank. A dot after a single letter or digit ends none.
    ender = any_of(_ENDERS)
    wide = ender & (cps > 255) & (cps != 0x2026)
    closed = ender & (kind_after == SPACE) & ((kind_before >= LOWER) & (kind_before <= LETTER) | any_of(")\"'”»`", before) | (kind_before == DIGIT) & (size.max() > 0)) | wide
    lone = np.concatenate([[SPACE, SPACE], kind[:-2]])
    closed &= ~((lone == SPACE) & ~wide)
    sentences = per_line(closed)
    c_first, c_last = cps[first], cps[last]
    in_set = lambda x, chars: np.isin(x, [ord(c) for c in chars])
    ended = (sentences > 0) & (words >= 3) | in_set(c_last, _ENDERS)
    end = np.where(ended, 2, np.where(in_set(c_last, ",:;-"), 1, 0))

    # How a line begins.
    second = cps[np.minimum(first + 1, n - 1)]
    k_first, k_second = kind[first], kind[np.minimum(first + 1, n - 1)]
    bullet = in_set(c_first, _BULLETS) & (k_second == SPACE) & (size > 1) | (c_first == 91) & ((second == 93) | (cps[np.minimum(first + 2, n - 1)] == 93))
    first_token = np.minimum(t0, len(t_at) - 1)
    ft_len, ft_digit, ft_end = t_len[first_token], t_digit[first_token], cps[t_end[first_token] - 1]
    number = (ft_len <= 5) & in_set(ft_end, ".):") & (ft_digit + in_set(c_first, "(") + 1 == ft_len) & (ft_digit > 0) | (ft_len == 2) & (k_first >= LOWER) & (k_first <= LETTER) & in_set(ft_end, ".)")
    number &= t1 - t0 > 1
    colon = np.flatnonzero(any_of(":=") & (kind_before != SPACE) & (kind_after == SPACE) | (cps == 61) | (cps == 45) & (after == 62) | (cps == 58) & (kind_before != SPACE))
    c0 = np.searchsorted(colon, begin)
    sep = np.where(c0 < len(colon), colon[np.minimum(c0, max(len(colon) - 1, 0))] if len(colon) else n, n)
    has = (sep < ends) & (sep < last) & (sep - first <= 31) & (sep > first)
    t_sep = np.searchsorted(t_at, np.minimum(sep, n - 1), side="right")
    named = has & (t1 - t_sep <= 3) & (t_sep - t0 <= 5) & (last - sep <= 60) & ~ended & (fields < 3)
    start = np.where(bullet, 1, np.where(number, 2, np.where(named, 3, np.where(c_first == 35, 4, np.where(c_first == 62, 5, 0)))))

    # The paragraph: lines up to the next blank one, without headings.
    new_par = blank_before | np.concatenate([[True], doc[1:] != doc[:-1]]) | (start == 4) | np.concatenate([[False], start[:-1] == 4])
    par = np.cumsum(new_par) - 1
    par_ends, par_words, par_lines = np.bincount(par, weights=np.where((start == 3) | (fields >= 3), 0, sentences)), np.bincount(par, weights=words), np.bincount(par)
    par_marked = np.bincount(par, weights=(start == 1) | (start == 2) | (start == 3) | (fields >= 2))
    paragraph = np.where(par_marked * 2 > par_lines, 3, np.where((par_ends > 0) & (par_words <= 70 * par_ends), 2, np.where(par_ends > 0, 1, 0)))[par]

    chars = np.add.reduceat(letter | (cps == 32), begin, dtype=np.int32) - np.where(first > begin, 0, 0)
    letters = np.minimum(1.0, (chars - (first - begin)) / size)
    line_hash = np.zeros(m, dtype=np.uint64)
    if len(t_at):
        spots = np.flatnonzero(inside)
        s0 = np.searchsorted(spots, first)
        key = (cps[spots].astype(np.uint64) + np.uint64(3)) * (np.uint64(0xFF51AFD7ED558CCD) ^ ((spots - np.repeat(first, size)).astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53)))
        key ^= key >> np.uint64(29)
        line_hash = np.add.reduceat(key, s0)
    same_doc = np.concatenate([[False], doc[1:] == doc[:-1]])
    prev_size, prev_hash = np.concatenate([[0], size[:-1]]), np.concatenate([[0], line_hash[:-1]]).astype(np.uint64)
    near = np.where(same_doc & (prev_hash == line_hash), 2, np.where(same_doc & (np.abs(prev_size - size) <= 12) & (words > 1), 1, 0))
    kinds_in = np.maximum.reduceat(np.where(inside, cps, 0), begin) == np.minimum.reduceat(np.where(inside, cps, 0xFFFFFF), begin)
    repeat = np.where(kinds_in & (size >= 6) | (words >= 4) & (distinct < np.where(words <= 12, 0.4, 0.2)), 2, np.where((words >= 4) & (distinct < 0.6), 1, 0))
    case = np.where(word_at[np.minimum(w0, len(word_at) - 1)] < ends, kind[word_at[np.minimum(w0, len(word_at) - 1)]], 0) if len(word_at) else np.zeros(m)
    case = np.where(words == 0, 0, np.where(case == LOWER, 1, 2))
    commas = per_line(any_of(_COMMAS) & ((kind_after == SPACE) | (cps > 255)) & (kind_before != SPACE)) > 0
    feats = np.stack([
        bins(words, 0, 1, 3, 8, 15, 30) * 4 + paragraph, start * 3 + bins(words, 4, 9), fields, bins(letters, 0.4, 0.7, 0.9), bins(odd_chars / size, 0.15, 0.5), bins(fit, 0.0, 0.3, 0.6),
        repeat, end, near, bins(size, 12, 45, 95), bins(short, 0.0, 0.12, 0.3), case, commas, np.zeros(m),
    ], axis=1).astype(np.uint8)
    return doc, size, feats, words.astype(np.int32), ((in_lines ^ (in_lines >> np.uint64(17))) % np.uint64(CELLS)).astype(np.uint16)


def cues(feats: np.ndarray) -> np.ndarray:
    """State of each line that is a plain case, else -1. Only the first counts of the model come from these."""
    f = dict(zip(NAMES, feats.T.astype(int), strict=True))
    start, f["paragraph"], f["words"] = f["start"] // 3, f["words"] % 4, f["words"] // 4
    out = np.full(len(feats), -1)

    def say(state: int, mask: np.ndarray) -> None:
        out[mask & (out < 0)] = state

    flat = f["fields"] < 2
    say(JUNK, (f["odd"] == 2) & (f["fields"] < 3) | (f["repeat"] == 2) & flat)
    say(JUNK, (f["pairs"] == 0) & (f["words"] >= 3) & (f["fields"] < 4))
    say(JUNK, (f["words"] >= 5) & (f["paragraph"] == 0) & (f["end"] == 0) & (f["lexicon"] <= 2) & (f["commas"] == 0) & flat & (start == 0))
    say(TABLE, (f["fields"] >= 3) & (f["paragraph"] == 3))
    say(TABLE, (f["fields"] == 2) & (f["paragraph"] == 3) & (f["end"] == 0))
    say(LIST, (start >= 1) & (start <= 3) & (f["words"] <= 3) & (f["end"] == 0) & (f["fields"] < 3))
    say(PROSE, (f["words"] >= 4) & (f["end"] == 2) & (f["paragraph"] == 2) & flat)
    say(PROSE, (f["words"] >= 4) & (f["lexicon"] >= 4) & (f["short"] >= 2) & (f["pairs"] >= 1) & flat & (start == 0))
    say(PROSE, (f["paragraph"] == 2) & (start == 0) & flat & (f["words"] >= 1) & (f["pairs"] >= 1))
    say(LIST, (start == 0) & (f["paragraph"] == 0) & (f["words"] >= 1) & (f["words"] <= 3) & (f["end"] == 0) & (f["fields"] == 0) & (f["near"] < 2))
    return out


def chunks(docs: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    """Texts in groups of about CHUNK_CHARS characters; a longer text is a group of its own."""
    size, ids, part = 0, [], []
    for d, t in zip(docs, texts, strict=True):
        if part and size + len(t) > CHUNK_CHARS:
            yield ids, part
            size, ids, part = 0, [], []
        ids.append(d)
        part.append(t)
        size += len(t)
    if part:
        yield ids, part


def _summed(df: DataFrame, run: Callable, size: int) -> np.ndarray:
    """The sum of the vectors that ``run`` makes of each partition: one number for each cell, whatever the data."""
    out = np.zeros(size)
    for r in df.mapInPandas(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def store_pairs(docs: DataFrame) -> np.ndarray:
    """Scores of the letter pairs over all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SYMBOLS * SYMBOLS)
        for pdf in batches:
            for _, texts in chunks(list(pdf["text"]), list(pdf["text"])):
                total += letter_pairs(texts)
        yield pd.DataFrame({"cell": np.arange(len(total)), "n": total})

    return pair_scores(_summed(docs.select("text"), run, SYMBOLS * SYMBOLS))


ENCODED = "doc_id bigint, features binary, lengths array<int>, counts binary, cells binary"


def encode(docs: DataFrame, pairs: np.ndarray) -> DataFrame:
    """doc_id, features (a byte each) of the non-blank lines, their lengths, and words; blank texts are dropped."""
    shared = docs.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ids, texts in chunks(list(pdf["doc_id"]), list(pdf["text"])):
                doc, size, feats, words, cells = line_features(texts, shared.value)
                upto = np.concatenate([[0], np.cumsum(words)])
                at = np.searchsorted(doc, np.arange(len(ids) + 1))
                rows += [
                    (ids[k], feats[a:b].tobytes(), size[a:b].astype(np.int32), words[a:b].tobytes(), cells[upto[a] : upto[b]].tobytes())
                    for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))
                    if b > a
                ]
            yield pd.DataFrame(rows, columns=["doc_id", "features", "lengths", "counts", "cells"])

    return materialise(docs.mapInPandas(run, ENCODED), "line-features")


def lexicon(encoded: DataFrame) -> np.ndarray:
    """Per cell of words: how much likelier it is in paragraphs with sentences than in lines without any (log 2), over all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, CELLS))
        for pdf in batches:
            for features, counts, cells in zip(pdf["features"], pdf["counts"], pdf["cells"], strict=True):
                f = np.frombuffer(features, dtype=np.uint8).reshape(-1, len(SIZES))
                inside = f[:, 0] % 4 == 2
                flat = f[:, 2] < 2
                of = np.repeat(np.where(inside & flat, 0, np.where(~inside & (f[:, 0] % 4 != 1), 1, 2)), np.frombuffer(counts, dtype=np.int32))
                words = np.frombuffer(cells, dtype=np.uint16)
                for k in (0, 1):
                    np.add.at(total[k], words[of == k], 1)
        flat = total.ravel()
        some = np.flatnonzero(flat)
        yield pd.DataFrame({"cell": some, "n": flat[some]})

    prose, other = _summed(encoded.select("features", "counts", "cells"), run, 2 * CELLS).reshape(2, CELLS) + 0.5
    return np.clip(np.log2(prose / prose.sum() / (other / other.sum())), -4, 4)


def blocks(pdf: pd.DataFrame, scores: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of about equal length side by side: their places in ``pdf``, lines (padded) and numbers of lines."""
    feats = [np.frombuffer(x, dtype=np.uint8).reshape(-1, len(SIZES)).copy() for x in pdf["features"]]
    for f, counts, cells in zip(feats, pdf["counts"], pdf["cells"], strict=True):
        n = np.frombuffer(counts, dtype=np.int32)
        at = np.concatenate([[0.0], np.cumsum(scores[np.frombuffer(cells, dtype=np.uint16)])])
        last = np.cumsum(n)
        f[:, -1] = bins((at[last] - at[last - n]) / np.maximum(n, 1), -2.0, -1.2, -0.4, 0.4, 1.2, 2.0)
    order = np.argsort([len(x) for x in feats], kind="stable")
    for lo in range(0, len(order), CHUNK_DOCS):
        mine = order[lo : lo + CHUNK_DOCS]
        size = np.array([len(feats[k]) for k in mine])
        out = np.zeros((len(mine), size.max(), len(SIZES)), dtype=np.int64)
        for j, k in enumerate(mine):
            out[j, : size[j]] = feats[k]
        yield mine, out, size


class Model:
    """Log probabilities: start, transition, and emission of each feature value."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        s = start + SMOOTH
        t = step + SMOOTH + np.eye(len(STATES)) * SMOOTH
        e = emit + SMOOTH
        self.start = np.log(s / s.sum())
        self.step = np.log(t / t.sum(1, keepdims=True))
        sums = np.add.reduceat(e, OFFSETS, axis=1)
        self.emit = np.log(e / np.repeat(sums, SIZES, axis=1))

    def scores(self, feats: np.ndarray) -> np.ndarray:
        """Emission scores (documents x lines x states)."""
        out = np.zeros((*feats.shape[:2], len(STATES)))
        for j, at in enumerate(OFFSETS):
            out += self.emit.T[feats[:, :, j] + at]
        return out

    def viterbi(self, feats: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Best states of the lines of documents side by side (lines after the last are 0)."""
        e = self.scores(feats)
        d, n, _ = e.shape
        back = np.zeros(e.shape, dtype=np.int8)
        at = self.start + e[:, 0]
        ends = at.copy()
        for k in range(1, n):
            through = at[:, :, None] + self.step
            back[:, k] = through.argmax(1)
            at = through.max(1) + e[:, k]
            ends = np.where((size > k)[:, None], at, ends)
        out = np.zeros((d, n), dtype=np.int64)
        now = ends.argmax(1)
        for k in range(n - 1, -1, -1):
            here = size > k
            out[here, k] = now[here]
            if k:
                now = np.where(here, back[np.arange(d), k, now], now)
        return out

    def expected(self, feats: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each line's state, and the expected number of each transition (forward and backward)."""
        e = np.exp(self.scores(feats) - self.scores(feats).max(2, keepdims=True))
        d, n, s = e.shape
        step = np.exp(self.step)
        live = (np.arange(n) < size[:, None])[:, :, None]
        fwd, bwd = np.zeros_like(e), np.ones_like(e)
        fwd[:, 0] = np.exp(self.start) * e[:, 0]
        fwd[:, 0] /= fwd[:, 0].sum(1, keepdims=True)
        for k in range(1, n):
            x = (fwd[:, k - 1] @ step) * e[:, k]
            fwd[:, k] = x / x.sum(1, keepdims=True)
        for k in range(n - 2, -1, -1):
            x = (e[:, k + 1] * bwd[:, k + 1]) @ step.T
            bwd[:, k] = np.where(live[:, k + 1], x / x.sum(1, keepdims=True), 1.0)
        post = fwd * bwd
        post = post / post.sum(2, keepdims=True) * live
        moves = np.zeros((s, s))
        for k in range(n - 1):
            x = fwd[:, k, :, None] * step * (e[:, k + 1] * bwd[:, k + 1])[:, None, :]
            x /= x.sum((1, 2), keepdims=True)
            moves += (x * live[:, k + 1][:, :, None]).sum(0)
        return post, moves


def fit_pass(encoded: DataFrame, scores: np.ndarray, model: Model | None) -> Model:
    """A new model: without one from the counts of the plain cases, else from the expected counts over all documents."""
    shared = encoded.sparkSession.sparkContext.broadcast((model, scores))
    n = len(STATES)
    seeds = encoded.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1000)) < int(1000 * SEED_SHARE)) if model is None else encoded

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, step, emit = np.zeros(n), np.zeros((n, n)), np.zeros((n, WIDTH))
        now, scores = shared.value
        for pdf in batches:
            for mine, feats, size in blocks(pdf, scores):
                if now is None:
                    post = np.zeros((*feats.shape[:2], n))
                    for j in range(len(mine)):
                        got = cues(feats[j, : size[j]])
                        known = np.flatnonzero(got >= 0)
                        post[j, known, got[known]] = 1
                    moves = np.einsum("dki,dkj->ij", post[:, :-1], post[:, 1:])
                else:
                    post, moves = now.expected(feats, size)
                start += post[:, 0].sum(0)
                step += moves
                for s in range(n):
                    for j, at in enumerate(OFFSETS):
                        emit[s, at : at + SIZES[j]] += np.bincount(feats[:, :, j].ravel(), weights=post[:, :, s].ravel(), minlength=SIZES[j])
        flat = np.concatenate([start, step.ravel(), emit.ravel()])
        yield pd.DataFrame({"cell": np.arange(len(flat)), "n": flat})

    cells = _summed(seeds.select("features", "counts", "cells"), run, n + n * n + n * WIDTH)
    return Model(cells[:n], cells[n : n + n * n].reshape(n, n), cells[n + n * n :].reshape(n, WIDTH))


def line_shares(encoded: DataFrame, scores: np.ndarray, model: Model) -> DataFrame:
    """doc_id, chars, the share of characters in lines of each state, and the lines that are plain cases and of those the ones labelled otherwise."""
    shared = encoded.sparkSession.sparkContext.broadcast((model, scores))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, scores = shared.value
        for pdf in batches:
            rows = []
            for mine, feats, size in blocks(pdf, scores):
                labels = model.viterbi(feats, size)
                for j, k in enumerate(mine):
                    got = labels[j, : size[j]]
                    by = np.bincount(got, weights=pdf["lengths"].iloc[k], minlength=len(STATES))
                    plain = cues(feats[j, : size[j]])
                    rows.append((pdf["doc_id"].iloc[k], int(by.sum()), *(by / max(1, by.sum())), int((plain >= 0).sum()), int(((plain >= 0) & (plain != got)).sum())))
            yield pd.DataFrame(rows, columns=["doc_id", "chars", *STATES, "cued", "moved"])

    return encoded.mapInPandas(run, "doc_id bigint, chars bigint, " + ", ".join(f"{s} double" for s in STATES) + ", cued int, moved int")


def document_shares(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Fit on ``docs`` (doc_id, text) and label them: doc_id, chars, prose, list, table, junk, cued, moved.

    Documents whose text is null or blank have no lines and no row.
    """
    docs = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    encoded = encode(docs, store_pairs(docs))
    scores = lexicon(encoded)
    model = fit_pass(encoded, scores, None)
    for _ in range(rounds):
        model = fit_pass(encoded, scores, model)
    return line_shares(encoded, scores, model)


def document_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, shape of every document that is more than half list, table or junk."""
    shares = document_shares(spread(spark, sf_dir, "documents", "doc_id", "text"))
    shape = F.when(F.col("list") > 0.5, "list").when(F.col("table") > 0.5, "table").when(F.col("junk") > 0.5, "junk")
    return shares.select("doc_id", shape.alias("shape")).filter(F.col("shape").isNotNull())


# The most common English words, for the share of common words.
COMMON_WORDS = ["the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "a", "it", "for", "was", "on", "as", "are", "not", "this", "by"]
#: A word: letters of any script with their marks, digits, and apostrophes between them.
WORD = r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}\p{N}]+)*"
#: Neither letter, mark, digit nor blank.
SYMBOL = r"[^\p{L}\p{M}\p{N}\p{Z}\t\n\r\f]"


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every document. Null text gives null figures; a text without words has 0 words and null word ratios, one without lines null line ratios."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("text", r"\r\n|\r|\n"), lambda s: F.trim(s) != "")
    parts = docs.withColumn("w", words).withColumn("s", lines)

    def ratio(a: Column, b: Column) -> Column:
        return F.round(F.try_divide(a.cast("double"), b), 4)

    return parts.select(
        "doc_id",
        F.when(F.col("text").isNotNull(), F.size("w")).cast("bigint").alias("words"),
        ratio(F.aggregate("w", F.lit(0), lambda a, w: a + F.length(w)), F.size("w")).alias("mean_word_length"),
        ratio(F.length(F.regexp_replace("text", SYMBOL, "")) * -1 + F.length("text"), F.length("text")).alias("symbol_ratio"),
        ratio(F.size(F.filter("s", lambda s: s.rlike(r"[.!?]\s*$"))), F.size("s")).alias("ended_lines"),
        ratio(F.size(F.filter("w", lambda w: F.lower(w).isin(COMMON_WORDS))), F.size("w")).alias("common_words"),
    )
