"""Toxicity by noisy-channel deobfuscation.

A reader sees "1d10t", "i d i o t" and "idiooot" as one word. Here the writer's word is the
hidden sequence and the written token the observed one: each written character is a node
of a lattice whose edges are the letters it may stand for (itself, its leetspeak letters,
nothing for an inserted separator or space, nothing for a repeat). A character trigram model
of the whole corpus, counted over every document, weighs the letters; the cheapest path
(Viterbi) is the restored word. Tokens without anything to restore stand for themselves.
Tokens of any length are decoded whole. Between letters any character that is no letter or
digit may be a separator. A token with a doubled letter is also read as written and with
every letter once, and one with separators by its pieces. In a run of three and more spaced
letters each space is an edge of the lattice too: it stands for nothing or for a word's end.
Such a run is also read as one word and cut where the character model puts ends: all words
on a path within MARGIN of the cheapest count.

The restored words and their beginnings of four to seven letters are hashed into 2**20
features. A batch's distinct tokens are read once; only those with something to restore go
through the lattice. From a bounded sample of labelled documents (SAMPLE ids, those with the
smallest hash, one text each) come the feature counts by label and a logistic fit of a few
statistics of each text's evidence; a sampled text's own label is taken out of the counts
when its statistics are formed. Every text is scored whole, in one narrow pass; the model
has a fixed size.

Null texts count as empty; texts without evidence get the score of no evidence. Without
usable labels (none, or one value only) every score is 0. Labels with one id count as one
row that is toxic if any is; of several texts with one labelled id one is learned from, by
its hash; null ids or labels teach nothing. Rows are neither merged nor dropped, equal texts
get equal scores, an empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textframe.llm._common import fresh, held_out, stored

#: Labelled rows from which the classifier is fitted at most.
SAMPLE = 50_000
FEATURES = 1 << 20
#: Letters that a written character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Characters that may be put between letters.
BETWEEN = ".-_*~'"
_STOPS = ".,;:?"
#: Cost above that of the cheapest way to cut a run of letters, up to which another's words count.
MARGIN = 6.0
_COST_LEET, _COST_GAP, _COST_REPEAT, _COST_DOUBLE, _COST_EDGE, _COST_OTHER = 1.0, 0.5, 0.7, 3.0, 1.5, 4.0
_DOUBLE = re.compile(r"([^\W\d_])\1")
_REPEATS = re.compile(r"([^\W\d_])\1+")
_PIECES = re.compile(r"[^\W_]+")
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")
_LETTER = re.compile(r"[^\W\d_]")
_CACHE = 80_000
#: Bytes of text that are read together, or one text.
_PART = 1_000_000
_SYMBOLS = 28
_LUT = np.zeros(256, np.int32)
_LUT[[*range(97, 123)]] = _LUT[[*range(65, 91)]] = np.arange(1, 27)
_LUT[128:] = 27


def _symbol(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27 if letter.isalpha() else 0


class Channel:
    """Restores words under a character model: counts of symbol triples, 28**3 of them."""

    def __init__(self, counts: np.ndarray):
        triples = counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS).astype(float)
        pairs, single = triples.sum(0), triples.sum((0, 1))
        one = (single + 1) / (single.sum() + _SYMBOLS)
        two = (pairs + 20 * one) / (pairs.sum(1, keepdims=True) + 20)
        self.first = (-np.log(two[0])).tolist()
        self.cost = (-np.log((triples + 20 * two[None]) / (triples.sum(2, keepdims=True) + 20))).tolist()
        self.seen: dict[str, tuple[str, ...]] = {}

    def restore(self, token: str) -> str:
        """The word behind a token, in lower case; itself if there is nothing to restore."""
        return self.readings(token)[0]

    def readings(self, token: str) -> tuple[str, ...]:
        """The word behind a token, and what else it may be read as."""
        found = self.seen.get(token)
        if found is None:
            found = self._readings(token.lower())
            if len(token) <= 40:  # longer ones are read each time anew
                if len(self.seen) >= _CACHE:
                    self.seen.clear()
                self.seen[token] = found
        return found

    def _readings(self, token: str) -> tuple[str, ...]:
        core = self._core(token)
        if core.isalpha():
            if not _DOUBLE.search(core):
                return (core,)
            found = [self.decode(core), core]
        elif _LETTER.search(core):
            found = [self.decode(core)]
            pieces = _PIECES.findall(core)
            if len(pieces) > 1:
                # a piece is read like a token of its own; it has no separators
                found += [x for piece in pieces if len(piece) > 2 for x in self.readings(piece)]
        else:
            return (core,)
        found += [_REPEATS.sub(r"\1", x) for x in found]
        return tuple(dict.fromkeys(found))

    def _core(self, token: str) -> str:
        """A token without what stands around its word."""
        core = token.rstrip(_STOPS)
        if core.isalpha():
            return core
        core = _OUTER.sub("", token)
        if token[:1] in LEET and token[1:2] != token[:1] and not token[:1].isdigit():
            return token[0] + _OUTER.sub("", token[1:])
        return core

    def decode(self, core: str) -> str:
        """The cheapest path through the lattice of a token, or of a run of spaced letters."""
        return self.cheapest(core)[1]

    def cheapest(self, core: str) -> tuple[float, str]:
        """The cheapest path's cost, and what it spells."""
        # by the last two symbols and the last written letter; what is written is a chain from its end
        paths: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        last = len(core) - 1
        often = len(_DOUBLE.findall(core)) > 1
        for at, char in enumerate(core):
            ways = [(x, _COST_LEET) for x in LEET.get(char, "")]
            if char.isalpha() or char == " ":
                ways.append((char, 0.0))
            elif char.isdigit() or not ways:
                ways.append((char, _COST_OTHER))
            new: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
            for (a, b, was), (cost, out) in paths.items():
                row = self.cost[a][b]
                for letter, price in ways:
                    s = _symbol(letter)
                    total = cost + price + row[s]
                    key = (b, s, letter)
                    if key not in new or new[key][0] > total:
                        new[key] = (total, (out, letter))
                again = was and (char == was or was in LEET.get(char, ""))
                if again:
                    drop = _COST_REPEAT if often or core[at - 2 : at + 1] == char * 3 or core[at - 1 : at + 2] == char * 3 else _COST_DOUBLE
                elif char.isalnum():
                    drop = None
                else:
                    drop = _COST_EDGE if at in (0, last) and char not in BETWEEN or char in LEET else _COST_GAP
                if drop is not None and (((a, b, was) not in new) or new[a, b, was][0] > cost + drop):
                    new[a, b, was] = (cost + drop, out)
            paths = new
        least, chain = min(((cost + self.cost[a][b][0], out) for (a, b, _), (cost, out) in paths.items()), key=lambda x: x[0])
        letters = []
        while chain is not None:
            chain, letter = chain
            letters.append(letter)
        return least, "".join(reversed(letters))

    def cut(self, run: str) -> set[str]:
        """The words of a run of letters on all paths through the lattice of their ends within MARGIN of the cheapest.

        A word costs what its letters cost after a space, and its end; words longer than any
        path can pay for are not followed further.
        """
        n = len(run)
        s = [_symbol(x) for x in run]
        cost = self.cost
        # inner[i]: the letter at i after the two before it; ends[i]: an end after i letters
        start = [self.first[x] for x in s]
        second = [0.0] + [cost[0][s[i - 1]][s[i]] for i in range(1, n)]
        inner = [0.0, 0.0] + [cost[s[i - 2]][s[i - 1]][s[i]] for i in range(2, n)]
        ends = [0.0] + [cost[s[i - 2] if i > 1 else 0][s[i - 1]][0] for i in range(1, n + 1)]
        alone = [cost[0][x][0] for x in s]
        words: list[tuple[int, int, float]] = []
        before = [0.0] + [math.inf] * n
        # open words by where they start; all pay the same for later letters, so the dear ones cannot catch up
        live: list[tuple[int, float]] = []
        for i in range(n):
            grown = [(j, c + (second[i] if j == i - 1 else inner[i])) for j, c in live]
            grown.append((i, before[i] + start[i]))
            least = min(c for _, c in grown)
            live = [(j, c) for j, c in grown if j >= i - 1 or c <= least + MARGIN + 20]
            for j, c in live:
                done = c + (alone[i] if j == i else ends[i + 1])
                words.append((j, i + 1, done - before[j]))
                before[i + 1] = min(before[i + 1], done)
        after = [math.inf] * n + [0.0]
        for j, i, c in reversed(words):
            after[j] = min(after[j], c + after[i])
        return {run[j:i] for j, i, c in words if i - j > 2 and before[j] + c + after[i] <= before[n] + MARGIN}

    def words(self, text: str) -> set[str]:
        """The restored words of a text."""
        return {x for token in set(text.split()) for x in self.readings(token)} | self.spaced(text)

    def spaced(self, text: str) -> set[str]:
        """The words in runs of three and more spaced letters."""
        found = set()
        for match in _SPACED.finditer(text):
            # whole, and where words are spaced wider, those
            wide = re.split(r"\s{2,}", match[0])
            for part in dict.fromkeys((match[0], *wide)):
                shown = " ".join(x for x in part.lower().split() if x.isalnum() or x in LEET)
                run = shown.replace(" ", "")
                if len(run) < 3:
                    continue
                for word in (*self.readings(run), *self.decode(shown).split()):
                    found.update((word, _REPEATS.sub(r"\1", word)))
                for word in self.readings(run):
                    if len(word) > 3:
                        found.update(self.cut(word))
        return found


_SEED = np.random.Generator(np.random.PCG64(3)).integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
#: Letters of the beginnings that are features.
BEGINNINGS = (4, 5, 6, 7)


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(place, feature): a word itself and its beginnings, for words of three letters and more; place: in words."""
    from textframe.llm._common import utf8

    raw, offsets = utf8(words)
    n = len(raw)
    powers = np.full(n + 1, _BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    back = np.full(n + 1, pow(_BASE, -1, 2**64), np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_SEED[raw] * powers[:-1], out=sums[1:])
    letter = np.append(np.flatnonzero(raw & 0xC0 != 0x80), n)  # where letters begin
    first = np.searchsorted(letter, offsets[:-1])
    long = np.flatnonzero(np.searchsorted(letter, offsets[1:]) - first > 2)
    start, end, first = offsets[long], offsets[long + 1], first[long]
    out = []
    for k in (0, *BEGINNINGS):
        stop = np.minimum(letter[np.minimum(first + k, len(letter) - 1)], end) if k else end
        x = (sums[stop] - sums[start]) * back[start] + np.uint64(k > 0)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        out.append((x >> np.uint64(44)).astype(np.int64))
    return np.tile(long, len(out)), np.concatenate(out)


class Reader:
    """From texts to the features of their words; keeps what it has restored between batches."""

    def __init__(self, characters: np.ndarray):
        self.channel = Channel(characters)

    def _tokens(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place, feature) of distinct tokens."""
        from textframe.llm._common import utf8

        low = pc.utf8_lower(pc.utf8_rtrim(tokens, _STOPS))
        raw, offsets = utf8(low)
        of = np.repeat(np.arange(len(low)), np.diff(offsets))
        twice = np.flatnonzero((raw[1:] == raw[:-1]) & (of[1:] == of[:-1]))
        doubles = np.bincount(of[twice], minlength=len(low))
        wide = np.bincount(of[raw >= 0x80], minlength=len(low)) > 0
        alpha = pc.utf8_is_alpha(low).to_numpy(zero_copy_only=False)
        plain = alpha & ((doubles == 0) if not wide.any() else (doubles == 0) & ~_repeats(raw, of, len(low)))
        # one doubled letter: the lattice has two paths, and both are readings
        pair = alpha & (doubles == 1) & ~wide
        whole = np.flatnonzero(plain | pair)
        once = np.flatnonzero(pair)
        keep = np.ones(len(raw), bool)
        keep[twice[pair[of[twice]]]] = False
        squeezed = raw[keep & pair[of]].tobytes() if len(once) else b""
        ends = np.append(0, np.cumsum(np.diff(offsets)[once] - 1))
        words = [low.take(pa.array(whole)), pa.LargeStringArray.from_buffers(len(once), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(squeezed))]
        owners = [whole, once]
        rest = np.flatnonzero(~(plain | pair))
        read, owner = [], []
        for at, token in zip(rest.tolist(), tokens.take(pa.array(rest)).to_pylist(), strict=True):
            for word in self.channel.readings(token):
                read.append(word.encode("utf-8", "replace").decode())
                owner.append(at)
        words.append(pa.array(read, pa.large_string()))
        owners.append(np.array(owner, np.int64))
        place, found = features(pa.concat_arrays(words))
        return np.concatenate(owners)[place], found

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature): the distinct features of each text, in order of texts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        cut = pc.utf8_split_whitespace(texts)
        flat = cut.flatten().dictionary_encode()
        at, tokens = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
        text = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
        place, found = self._tokens(tokens)
        order = np.argsort(place, kind="stable")
        place, found = place[order], found[order]
        n = np.bincount(place, minlength=len(tokens))
        pairs = _distinct(text * len(tokens) + at)
        of, token = pairs // max(1, len(tokens)), pairs % max(1, len(tokens))
        many = n[token] if len(tokens) else np.zeros(0, np.int64)
        shift = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        codes = [np.repeat(of, many) * FEATURES + found[np.repeat((np.cumsum(n) - n)[token] if len(tokens) else many, many) + shift]]
        single = (pc.utf8_length(tokens).to_numpy(zero_copy_only=False) == 1)[at] if len(tokens) else np.zeros(0, bool)
        runs = single[2:] & single[1:-1] & single[:-2] & (text[2:] == text[:-2])
        for i in np.unique(text[2:][runs]).tolist():
            words = sorted(x.encode("utf-8", "replace").decode() for x in self.channel.spaced(texts[i].as_py()))
            codes.append(i * FEATURES + features(pa.array(words, pa.large_string()))[1])
        codes = _distinct(np.concatenate(codes))
        return codes // FEATURES, codes % FEATURES


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _repeats(raw: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Tokens in which a letter of two or more bytes may stand twice in a row."""
    out = np.zeros(n, bool)
    for k in (2, 3, 4):
        same = raw[k:] == raw[:-k]
        begins = (raw[:-k] >= 0xC0) & same & (of[k:] == of[:-k])
        begins[: len(begins) - 1] &= same[1:]
        out[of[:-k][begins]] = True
    return out


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of symbol triples over all texts; at most 28**3 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textframe.llm._common import parts, utf8

        total = np.zeros(_SYMBOLS**3, np.int64)
        for batch in parts(batches, "text", _PART):
            raw, offsets = utf8(batch.column("text"))
            at = _LUT[raw]
            wide = np.zeros(len(at) + 3 * batch.num_rows, np.int32)  # texts are apart from each other
            wide[np.arange(len(at)) + 3 * np.repeat(np.arange(batch.num_rows), np.diff(offsets))] = at
            total += np.bincount(wide[:-2] * _SYMBOLS**2 + wide[1:-1] * _SYMBOLS + wide[2:], minlength=_SYMBOLS**3)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    out = np.zeros(_SYMBOLS**3, np.int64)
    for code, n in sums.collect():
        out[code] = n
    out[0] = 0  # what lies between words
    return out


def _evidence(text: np.ndarray, feature: np.ndarray, n: int, toxic: np.ndarray, clean: np.ndarray, totals: tuple[float, float], own: np.ndarray | None = None) -> np.ndarray:
    """Statistics of the log odds of the features of n texts. own: the texts' labels, if they are among the counts."""
    t, c = toxic[feature].astype(float), clean[feature].astype(float)
    t_all, c_all = totals
    if own is not None:
        t, c = t - own[text], c - (1 - own[text])
    known = t + c >= 3
    text, t, c = text[known], t[known], c[known]
    base = t_all / (t_all + c_all)
    odds = np.log((t + 2 * base) / (c + 2 * (1 - base))) - math.log(base / (1 - base))
    order = np.lexsort((-odds, text))
    text, odds = text[order], odds[order]
    count = np.bincount(text, minlength=n)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    over = np.clip(odds, 0, None)
    sums = lambda which, what: np.bincount(text[which], what[which], n)
    strong = np.bincount(text[odds > 1.5], minlength=n)
    mean = np.bincount(text, odds, n) / np.maximum(1, count)
    return np.stack([np.ones(n), sums(rank == 0, over), sums(rank < 5, over), np.log1p(strong), np.log1p(count), mean], 1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Fixed size: 28**3 character counts, 2 x 2**20 feature counts, six weights."""

    def __init__(self, characters: np.ndarray):
        self.characters = characters
        self.toxic = self.clean = np.zeros(0, np.int32)
        self.totals = (0.0, 0.0)
        self.weights: np.ndarray | None = None

    def reader(self) -> Reader:
        """Made once in each task."""
        return Reader(self.characters)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns characters from all texts, and labels from a bounded sample outside the held-out fold."""
    spark = docs.sparkSession
    model = Model(character_counts(docs, text_col))
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
    usable = usable.groupBy(F.col(id_col).alias("of")).agg(F.max(F.col(label).cast("int")).alias("y"))
    rows = usable.orderBy(F.xxhash64("of"), "of").limit(sample)
    rows = spark.createDataFrame(rows.collect(), rows.schema)  # bounded by `sample`
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(rows), F.col("id") == F.col("of"))
    # one text for each id, so what is learned from and what reaches the driver is bounded whatever the ids
    texts = texts.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("x")).select("id", "x.text", "y")
    texts = stored(texts, "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textframe.llm._common import parts

        reader, n = model.reader(), np.zeros((2, FEATURES), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in parts(batches, "text", _PART):
            y = (batch.column("y").to_numpy(zero_copy_only=False) > 0).astype(np.int64)
            text, feature = reader.read(batch.column("text"))
            n += np.bincount(y[text] * FEATURES + feature, minlength=2 * FEATURES).reshape(2, -1)
            rows += np.bincount(y, minlength=2)
        at = np.flatnonzero(n.any(0))
        n = n.astype(np.int32)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000]), pa.array(n[1][at[i : i + 100_000]]), pa.array(n[0][at[i : i + 100_000]])], ["at", "t", "c"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([rows[1]], pa.int32()), pa.array([rows[0]], pa.int32())], ["at", "t", "c"])

    sums = texts.mapInArrow(count, "at bigint, t int, c int").groupBy("at").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # at most a row for each feature; those of fewer than three texts never count as evidence
    got = sums.filter("at < 0 or t + c >= 3").toArrow()
    at, t, c = (got.column(x).to_numpy() for x in ("at", "t", "c"))
    total = at < 0
    if not total.any() or not t[total][0] or not c[total][0]:
        return model
    model.totals = (float(t[total][0]), float(c[total][0]))
    model.toxic, model.clean = np.zeros(FEATURES, np.int32), np.zeros(FEATURES, np.int32)
    model.toxic[at[~total]], model.clean[at[~total]] = t[~total], c[~total]
    shared = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textframe.llm._common import parts

        m = shared.value
        reader = m.reader()
        for batch in parts(batches, "text", _PART):
            y = (batch.column("y").to_numpy(zero_copy_only=False) > 0).astype(np.int64)
            x = _evidence(*reader.read(batch.column("text")), len(y), m.toxic, m.clean, m.totals, y)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(x), pa.list_(pa.float64())), pa.array(y.astype(np.int32))], ["id", "x", "y"])

    points = texts.mapInArrow(weigh, T.StructType([texts.schema["id"], T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("y", T.IntegerType())])).toPandas()
    points = points.sort_values("id", kind="stable")  # else the last bits would depend on the rows' order
    model.weights = _logistic(np.stack(points["x"].to_numpy()), points["y"].to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """(id_col, keep..., score) for each row of docs, in one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = (id_col, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textframe.llm._common import parts

        m = shared.value
        reader = m.reader()
        for batch in parts(batches, "_text", _PART):
            if m.weights is None:
                p = np.zeros(batch.num_rows)
            else:
                x = _evidence(*reader.read(batch.column("_text")), batch.num_rows, m.toxic, m.clean, m.totals)
                p = 1 / (1 + np.exp(-np.clip(x @ m.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(p)], [*batch.schema.names[:-1], "_score"])

    schema = T.StructType([T.StructField(f"_{i}", docs.schema[c].dataType) for i, c in enumerate(names)] + [T.StructField("_score", T.DoubleType())])
    columns = [F.col(c).alias(f"_{i}") for i, c in enumerate(names)]
    return docs.select(*columns, F.col(text_col).alias("_text")).mapInArrow(run, schema).toDF(*names, out)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What op3 returns."""
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score is below one half; columns stay."""
    name = fresh(docs, "score")
    scored = score(docs, fit(docs, labels), keep=tuple(c for c in docs.columns if c != "doc_id"), out=name)
    return scored.filter(F.col(name) < 0.5).select(*docs.columns)
