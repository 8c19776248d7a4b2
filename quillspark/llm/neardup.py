"""Near duplicates by Order MinHash, verified by banded alignment.

Words are lower-cased and stripped of signs at their ends; each character of a script that is
written without spaces is a word. A text's k-mers are runs of three
words, each labelled with its occurrence number. Each of SKETCHES hash functions takes the
PICKED least k-mers and keeps them in text order; two texts whose ordered picks are equal
agree on that sketch. Texts of few words have few k-mers, so they also agree if they are equal
once a word is left out of one or both, which of such texts all similar ones are.
Equal texts form a class first, by hash, and only one row of each goes on.

Candidates: each text is compared with the first one of every group that agrees on a sketch, so
the number of pairs grows with the number of texts, however large a group. What isn't in the
first one's class by then is compared with all others of its groups: as pairs in groups of up to LEADERS + 1
texts, and in blocks of rows in larger ones. A block is one task's: it leaves out pairs whose words can't have
enough in common, verifies the others, the likeliest first, skips those whose classes have been joined, and returns
the links that join classes, fewer than it has rows. So any two texts that agree on a sketch are compared or in one
class, however large their groups, and no table has a row for each pair of a large group.

Verification: the longest common subsequence of the words is found within the band of
diagonals that a similarity of 0.8 allows; similarity is its length by the longer text's
words. Links go to components by alternating stars; nothing is collected.

Null and empty texts are equal to each other. Texts without words are similar only to equal
texts; of one or two words, the whole text is what is hashed. Classes are of rows by their texts,
whatever their ids: rows of one id may be in different classes, and rows with a null id
are in that of their text. A class is named by the least id of its rows, null where
none has one. No rows give no classes. Of columns other than doc_id and text nothing is read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import stashed
from quillspark.sources.shared import passing

WORDS = 3
SKETCHES = 32
#: Others of a group that a text is paired with; larger groups are compared in blocks.
LEADERS = 8
#: Rows and words of either side of a block, about; rows of one side that are compared at a time; classes of words by which they are.
SIDE, SIDE_WORDS, ASKING, BAG = 1024, 1 << 21, 64, 256
MOST_OF_BAG = 65_535
PICKED = 2
SIMILAR = 0.8
#: Words of the longest texts that are similar only with all but one of the longer one's words in common, and of the longest that must be equal.
FEW, FEWEST = 9, 4
#: Characters whose words are hashed at a time.
PORTION = 1 << 18
#: k-mers that are hashed at a time.
BLOCK = 4096
#: Words of one text that are aligned at a time with the other's.
CHUNK = 4096

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_SPACE = re.compile(r"\s")
# Code points of scripts without spaces (Thai and Lao, Burmese, Khmer, Chinese and Japanese).
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_SEEDS = mixed(np.arange(1, SKETCHES + 1, dtype="uint64") * _GOLD)
_FACTORS = mixed(np.arange(101, SKETCHES + 101, dtype="uint64") * _GOLD) | np.uint64(1)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Characters:
    """Of each character whether it is white space (1), part of a word (2), a word (3) or a sign (0), as far as met."""

    def __init__(self):
        self.kinds = np.full(0x110000, 255, "uint8")

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        got = self.kinds[codes]
        if (got == 255).any():
            for c in np.unique(codes[got == 255]).tolist():
                char = chr(c)
                alone = any(a <= c <= b for a, b in _UNSPACED)
                word = char.isalnum() or char == "_" or alone and unicodedata.category(char)[0] == "M"
                self.kinds[c] = 1 if char.isspace() else 0 if not word else 3 if alone else 2
            got = self.kinds[codes]
        return got


class _Powers:
    """Powers of the base and of its inverse, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, "uint64")

    def grow(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, "uint64")], dtype="uint64") for b in (_BASE, pow(_BASE, -1, 1 << 64)))


_CHARACTERS, _POWERS = _Characters(), _Powers()


def _hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of text, without signs at their ends, and where they begin."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _CHARACTERS(codes)
    at = np.flatnonzero(kind >= 2)
    if not len(at):
        return np.zeros(0, "uint64"), at
    gap = np.cumsum(kind == 1)[at]
    alone = kind[at] == 3
    first = np.r_[True, (gap[1:] != gap[:-1]) | alone[1:] | alone[:-1]]
    start, stop = at[first], at[np.r_[first[1:], True]] + 1
    _POWERS.grow(max(PORTION, len(codes)) + 1)
    total = np.zeros(len(codes) + 1, "uint64")
    np.cumsum((codes.astype("uint64") + np.uint64(1)) * _POWERS.up[: len(codes)], out=total[1:])
    h = (total[stop] - total[start]) * _POWERS.down[start]
    return mixed(h + (stop - start).astype("uint64") * _MIX1) | np.uint64(1), start


def words_of(texts: list[str | None]) -> list[np.ndarray]:
    """A 64-bit hash for each word of each text; words of signs only are left out."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    together: list[tuple[int, str]] = []
    size = 0

    def done() -> None:
        nonlocal size
        if together:
            h, start = _hashed("\n".join([t for _, t in together]))
            ends = np.cumsum([len(t) + 1 for _, t in together])
            for (i, _), own in zip(together, np.split(h, np.searchsorted(start, ends[:-1]))):
                out[i].append(own)
        together.clear()
        size = 0

    for i, text in enumerate(texts):
        text = (text or "").lower()
        at = 0
        while at < len(text):
            # long texts are cut at white space
            cut = _SPACE.search(text, at + PORTION) if len(text) - at > PORTION else None
            part = text[at : cut.start() if cut else len(text)]
            if size + len(part) > PORTION:
                done()
            together.append((i, part))
            size += len(part)
            at += len(part)
    done()
    return [parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, "uint64"), *parts]) for parts in out]


def word_hashes(text: str | None) -> np.ndarray:
    return words_of([text])[0]


def kmers(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of three words, labelled with their occurrence numbers, one text after the other; and how many each has."""
    sizes = np.asarray([len(t) for t in texts])
    counts = np.maximum(1, sizes - WORDS + 1)
    words = np.concatenate([t if len(t) >= WORDS else np.r_[t, np.zeros(WORDS - len(t), "uint64")] for t in texts])
    starts = np.cumsum(np.maximum(sizes, WORDS)) - np.maximum(sizes, WORDS)
    own = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[own]
    h = np.minimum(sizes, WORDS).astype("uint64")[own]
    for k in range(WORDS):
        h = mixed(h * _GOLD + words[at + k])
    with_text = h ^ mixed(own.astype("uint64") + np.uint64(1))
    order = np.argsort(with_text, kind="stable")
    s = with_text[order]
    new = np.r_[True, s[1:] != s[:-1]]
    if not new.all():
        n = np.arange(len(h))
        label = np.empty(len(h), "uint64")
        label[order] = (n - np.maximum.accumulate(np.where(new, n, 0))).astype("uint64")
        h = np.where(label > 0, mixed(h + label * _GOLD), h)
    return h, counts


def _least(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash function and each text, from starts on, the PICKED least values and their places; ties go to the first."""
    low = np.uint64((1 << (len(h) - 1).bit_length()) - 1)
    v = (h[None, :] ^ _SEEDS[:, None]) * _FACTORS[:, None]
    v &= ~low
    v |= np.arange(len(h), dtype="uint64")
    rows = np.arange(SKETCHES)[:, None]
    values, places = [], []
    for _ in range(PICKED):
        m = np.minimum.reduceat(v, starts, axis=1)
        p = (m & low).astype("int64")
        values.append(m & ~low)
        places.append(p)
        v[rows, p] = _MOST
    return np.stack(values), np.stack(places)


def _combined(h: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One number for the picks of each hash function and text, in text order."""
    places = np.sort(places, axis=0)
    out = np.broadcast_to(_SEEDS[:, None], places.shape[1:]).copy()
    for p in places:
        out = mixed(out * _GOLD + h[p])
    return out.T


def sketches(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text's words, one number for each hash function; texts must have words."""
    out: list[np.ndarray | None] = [None] * len(texts)
    todo: list[int] = []
    size = 0

    def done() -> None:
        nonlocal size
        if todo:
            h, counts = kmers([texts[i] for i in todo])
            starts = np.cumsum(counts) - counts
            got = _combined(h, _least(h, starts)[1])
            for k, i in enumerate(todo):
                out[i] = got[k]
        todo.clear()
        size = 0

    for i, t in enumerate(texts):
        n = max(1, len(t) - WORDS + 1)
        if n <= PICKED:  # all k-mers are picked
            h, _ = kmers([t])
            out[i] = mixed(np.bitwise_xor.reduce(h * np.arange(1, n + 1, dtype="uint64") * _GOLD) + _SEEDS)
        elif n > BLOCK:
            h, _ = kmers([t])
            # BLOCK k-mers at a time, one less where a single one would be left
            edges = [*range(0, n - PICKED, BLOCK), n]
            found = [_least(h[a:b], np.asarray([0])) for a, b in zip(edges, edges[1:])]
            values = np.concatenate([v[:, :, 0] for v, _ in found])
            places = np.concatenate([p[:, :, 0] + a for (_, p), a in zip(found, edges)])
            best = np.argsort(values, axis=0, kind="stable")[:PICKED]
            out[i] = _combined(h, np.take_along_axis(places, best, 0)[:, :, None])[0]
        else:
            if size + n > BLOCK:
                done()
            todo.append(i)
            size += n
    done()
    return out


def shortened(words: np.ndarray) -> np.ndarray:
    """Of a text of few words a number for all of them, and one for those but each; similar texts have one in common, others none."""
    n = len(words)
    if not FEWEST <= n <= FEW:
        return np.zeros(0, "uint64")
    rows = [words[None, :]]
    if n > FEWEST:
        rows.append(words[np.asarray([[i for i in range(n) if i != k] for k in range(n)])])
    out = []
    for own in rows:
        h = np.full(len(own), own.shape[1], "uint64")
        for w in own.T:
            h = mixed(h * _GOLD + w)
        out.append(h)
    return np.unique(np.concatenate(out))


def common_within(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """The length of the longest common subsequence, or None if it takes over limit insertions and deletions.

    Rows are read as bits of a number, CHUNK words of a at a time; of b only those within limit
    diagonals of them.
    """
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    if n:
        same = a[::-1][:n] == b[::-1][:n]
        tail = n if same.all() else int(same.argmin())
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        head += tail
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return None
    if not n or not m:
        return head if n + m <= limit else None
    x, y = a.tolist(), b.tolist()
    carries = bytearray(m)  # of each row of b, what the chunk before hands on
    found = 0
    for low in range(0, n, CHUNK):
        high = min(n, low + CHUNK)
        width = high - low
        full = (1 << width) - 1
        places: dict[int, int] = {}
        for i, w in enumerate(x[low:high]):
            places[w] = places.get(w, 0) | 1 << i
        first, last = max(0, low - limit), min(m, high + limit)
        carries[:first] = bytes(first)
        v = full
        for j in range(first, last):
            u = v & places.get(y[j], 0)
            s = v + u + carries[j]
            v = (s | (v - u)) & full
            carries[j] = s >> width
        found += width - v.bit_count()
        carries[last:] = bytes(m - last)
    return head + found if n + m - 2 * found <= limit else None


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """Common subsequence by the longer one's words; 0 if below least."""
    longer = max(len(a), len(b))
    if not longer or min(len(a), len(b)) < least * longer - 1e-9:
        return 0.0
    if longer > 300 and (Counter(a.tolist()) & Counter(b.tolist())).total() < least * longer - 1e-9:
        return 0.0
    got = common_within(a, b, int(len(a) + len(b) - 2 * least * longer + 1e-9))
    return got / longer if got is not None and got >= least * longer - 1e-9 else 0.0


def signatures(docs: DataFrame) -> DataFrame:
    """doc (the row), row (a number of its own), n (of words), sketches (empty for texts without words; those of few words have more)."""
    schema = T.StructType([T.StructField("doc", docs.schema, False), T.StructField("row", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sketches", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            words = words_of(batch.column(1).to_pylist())
            some = [i for i, w in enumerate(words) if len(w)]
            got: list[list[int]] = [[]] * len(words)
            for i, s in zip(some, sketches([words[i] for i in some])):
                got[i] = np.concatenate([s, shortened(words[i])]).view("int64").tolist()
            arrays = [batch.column(0), pa.array(range(row, row + len(words)), pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array(got, pa.list_(pa.int64()))]
            row += len(words)
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "row", "n", "sketches"])

    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def text_hash(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def verified(pairs: DataFrame, texts: DataFrame, most: bool) -> DataFrame:
    """pairs of node and leader with similar, whether their texts are; lengths alone tell many that aren't.

    Where most texts are in pairs, all travel to them; else only those that are.
    """
    sizes = texts.select("node", "n").hint("merge")
    fits = F.least("n", "m") >= SIMILAR * F.greatest("n", "m") - 1e-9
    near = stashed(pairs.join(sizes, "node").join(sizes.select(F.col("node").alias("leader"), F.col("n").alias("m")), "leader").where(fits).select("node", "leader"))
    if near.isEmpty():
        return near.withColumn("similar", F.lit(False))
    if not most:
        texts = stashed(texts.join(near.select("node").union(near.select("leader")).distinct(), "node", "left_semi"))
    wide = (
        near.join(texts.select(F.col("node").alias("leader"), F.col("text").alias("b")).hint("merge"), "leader")
        .join(texts.select("node", F.col("text").alias("a")).hint("merge"), "node")
        .select("node", "leader", "a", "b")
    )
    schema = pa.schema([("node", pa.int64()), ("leader", pa.int64()), ("similar", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(words_of(batch.column(2).to_pylist()), words_of(batch.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([similarity(a, b) >= SIMILAR for a, b in both], pa.bool_())], schema=schema)

    return stashed(wide.mapInArrow(run, "node bigint, leader bigint, similar boolean"))


def dealt(own: DataFrame) -> DataFrame:
    """key, node, n, leader (the first one) and size of each group that agrees on a sketch."""
    keyed = own.select("node", "n", F.explode("sketches").alias("key"))
    groups = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last"), F.count(F.lit(1)).alias("size")).where("leader < last")
    return stashed(keyed.join(stashed(groups.select("key", "leader", "size")).hint("merge"), "key"))


def named(rows: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """rows with the class of node so far."""
    own = labels.select(F.col("node").alias(node), F.col("leader").alias(label))
    return rows.join(own, node, "left").withColumn(label, F.coalesce(label, node))


def worded(texts: DataFrame) -> DataFrame:
    """node and the hashes of its text's words, 8 bytes each."""
    schema = pa.schema([("node", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.tobytes() for w in words_of(batch.column(1).to_pylist())], pa.binary())], schema=schema)

    return texts.select("node", "text").mapInArrow(run, "node bigint, words binary")


def bag_of(words: np.ndarray) -> bytes:
    """How many of the words fall to each of BAG hashed classes, as 16-bit numbers."""
    return np.minimum(np.bincount((mixed(words) % np.uint64(BAG)).astype("int64"), minlength=BAG), MOST_OF_BAG).astype("<u2").tobytes()


def likely_pairs(group: pa.Table) -> pa.Table:
    """node, leader and common, what words they have in common at most, of the rows apart with all of other classes, where that is enough.

    A common subsequence can't have more words than the classes of words have in common.
    """
    node, n, x, apart, asks = (group.column(c).to_numpy() for c in ("node", "n", "x", "apart", "asks"))
    bag = np.frombuffer(b"".join(group.column("bag").to_pylist()), "<u2").reshape(len(node), BAG)
    there = np.flatnonzero(~asks)
    there = there[np.argsort(n[there], kind="stable")]
    size, own, label, also, bags_there = n[there], node[there], x[there], apart[there], np.ascontiguousarray(bag[there])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in np.flatnonzero(asks).tolist():
        low, high = np.searchsorted(size, SIMILAR * n[i] - 1e-6), np.searchsorted(size, n[i] / SIMILAR + 1e-6, "right")
        near = np.arange(low, high)
        near = near[(label[near] != x[i]) & (~also[near] | (own[near] > node[i]))]
        if not len(near):
            continue
        common = np.minimum(bags_there[near], bag[i]).sum(1, dtype="int64")
        longer = np.maximum(size[near], n[i])
        fits = (common >= SIMILAR * longer - 1e-6) | (longer > MOST_OF_BAG)
        near, common = near[fits], common[fits]
        out.append((np.maximum(own[near], node[i]), np.minimum(own[near], node[i]), common))
    columns = [np.concatenate([np.zeros(0, "int64"), *(o[k] for o in out)]) for k in range(3)]
    return pa.table(columns, names=["node", "leader", "common"])


def decided(block: pa.Table) -> pa.Table:
    """node and leader of links that join the classes (x) of a block's rows, as far as pairs of an asking and an asked row are similar.

    Pairs of rows that have several groups in common are left to the one with the least key. What has been
    joined by a link isn't verified again, so there are fewer links than rows.
    """
    node, x, asks, asked = (block.column(c).to_numpy() for c in ("node", "x", "asks", "asked"))
    key, keys = block.column("key")[0].as_py(), [set(k) for k in block.column("keys").to_pylist()]
    words = [np.frombuffer(w, "uint64") for w in block.column("words").to_pylist()]
    at = {own: i for i, own in enumerate(node.tolist())}
    rows = pa.table([block.column("node"), pa.array([len(w) for w in words], pa.int64()), block.column("apart"), pa.array([bag_of(w) for w in words], pa.binary())], names=["node", "n", "apart", "bag"])
    joined: dict[int, int] = {}  # classes that are part of others by now

    def label(own: int) -> int:
        while own in joined:
            own = joined[own]
        return own

    out: list[tuple[int, int]] = []
    asking, there = np.flatnonzero(asks), np.flatnonzero(asked)
    for low in range(0, len(asking), ASKING):
        both = np.r_[asking[low : low + ASKING], there]
        now = np.asarray([label(c) for c in x[both].tolist()], "int64")
        group = rows.take(pa.array(both)).append_column("x", pa.array(now)).append_column("asks", pa.array(np.arange(len(both)) < len(both) - len(there)))
        likely = likely_pairs(group)
        order = np.argsort(-likely.column("common").to_numpy(), kind="stable")
        for a, b in zip(likely.column("node").to_numpy()[order].tolist(), likely.column("leader").to_numpy()[order].tolist()):
            i, j = at[a], at[b]
            one, other = label(int(x[i])), label(int(x[j]))
            if one == other or min(keys[i] & keys[j]) != key or similarity(words[i], words[j]) < SIMILAR:
                continue
            joined[max(one, other)] = min(one, other)
            out.append((a, b))
    return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["node", "leader"])


def unmet(placed: DataFrame, texts: DataFrame) -> DataFrame | None:
    """node and leader of links that join what is similar and of different classes in a group, or None if no group has two classes.

    placed has key, node, n, size, x (the class) and apart (not in the class of the group's first). Of two rows of different classes
    at least one is apart: those ask all. Both sides are dealt into parts of about SIDE rows or SIDE_WORDS words, and a block
    is one of either, so that no task gets a whole large group.
    """
    apart = F.col("apart")
    sums = [F.count(F.lit(1)).alias("n_all"), F.sum("n").alias("words_all"), F.count(F.when(apart, 1)).alias("n_apart"), F.sum(F.when(apart, F.col("n"))).alias("words_apart")]
    parts = [F.ceil(F.greatest(F.col(f"n_{k}") / SIDE, F.col(f"words_{k}") / SIDE_WORDS)).cast("int").alias(f"of_{k}") for k in ("apart", "all")]
    groups = stashed(placed.groupBy("key").agg(*sums).where("n_apart > 0").select("key", *parts))
    if groups.isEmpty():
        return None
    # a row for each text, which meets its words once, with all of its groups, of which it has SKETCHES + FEW + 1 at most
    homes = stashed(placed.join(groups, "key").groupBy("node", "x").agg(F.collect_list(F.struct("key", "apart", "of_apart", "of_all")).alias("homes")))
    own = stashed(worded(texts.join(homes.select("node"), "node", "left_semi")))
    a, b = (F.pmod(F.xxhash64("node", F.lit(k)), F.col(c)).cast("int") for k, c in enumerate(("home.of_apart", "home.of_all")))
    asked = F.transform(F.sequence(F.lit(0), F.col("home.of_apart") - 1), lambda k: F.struct(k.alias("a"), F.col("b").alias("b"), (F.col("home.apart") & (k == F.col("a"))).alias("asks"), F.lit(True).alias("asked")))
    others = F.filter(F.sequence(F.lit(0), F.col("home.of_all") - 1), lambda k: F.col("home.apart") & (k != F.col("b")))
    asking = F.transform(others, lambda k: F.struct(F.col("a").alias("a"), k.alias("b"), F.lit(True).alias("asks"), F.lit(False).alias("asked")))
    dealt_to = homes.join(own, "node").select("node", "x", "words", F.col("homes.key").alias("keys"), F.explode("homes").alias("home")).withColumn("a", a).withColumn("b", b)
    blocks = dealt_to.select("node", "x", "words", "keys", "home.key", "home.apart", F.explode(F.concat(asked, asking)).alias("block")).select("node", "x", "words", "keys", "key", "apart", "block.*")
    return stashed(blocks.groupBy("key", "a", "b").applyInArrow(decided, "node bigint, leader bigint").distinct())


def links(signed: DataFrame, reps: DataFrame) -> DataFrame:
    """node and the least node of its class, for the nodes in reps, which stand for different texts; a node alone isn't there."""
    texts = signed.where("n > 0").select(F.col("row").alias("node"), "n", F.col("doc.text").cast("string").alias("text"))
    own = stashed(signed.where("n > 0").select(F.col("row").alias("node"), "n", "sketches").join(reps.select("node").hint("merge"), "node", "left_semi"))
    members = dealt(own)
    # only these texts travel, whatever they are compared with
    texts = stashed(texts.join(members.select("node").distinct().hint("merge"), "node", "left_semi"))
    tested = verified(members.where("node <> leader").select("node", "leader").distinct(), texts, True)
    labels = components(tested.where("similar").select("node", "leader"))
    # those that aren't in the first one's class, in groups that have others too
    placed = stashed(named(named(members.where("size > 2"), labels, "node", "x"), labels, "leader", "y").select("key", "node", "n", "size", "x", (F.col("x") != F.col("y")).alias("apart")))
    small = F.col("size") <= LEADERS + 1
    others = placed.where(small).select("key", F.col("node").alias("leader"), F.col("x").alias("y"))
    pairs = placed.where(small & F.col("apart")).select("key", "node", "x").join(others, "key").where("x <> y").select(F.greatest("node", "leader").alias("node"), F.least("node", "leader").alias("leader")).distinct()
    found = verified(pairs.join(tested, ["node", "leader"], "left_anti"), texts, False).where("similar").select("node", "leader")
    if (more := unmet(placed.where(~small), texts)) is not None:
        found = found.unionByName(more)
    return labels if found.isEmpty() else components(labels.unionByName(found))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and the least id of its component, from edges (node, leader), by alternating stars."""

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e if not large else e.unionByName(e.select(F.col("leader").alias("node"), F.col("node").alias("leader")))
        # written, so that the join can split the edges of a star's centre
        least = stashed(both.groupBy("node").agg(F.min("leader").alias("m")).select("node", F.least("node", "m").alias("m")))
        joined = both.join(least, "node")
        if large:  # larger neighbours get the least of all
            return joined.where("leader > node").select(F.col("leader").alias("node"), F.col("m").alias("leader")).distinct()
        out = joined.where("leader <> m").select(F.col("leader").alias("node"), F.col("m").alias("leader"))
        return out.unionByName(least.select("node", F.col("m").alias("leader"))).where("node <> leader").distinct()

    e = stashed(edges.where("node <> leader").select(F.greatest("node", "leader").alias("node"), F.least("node", "leader").alias("leader")).distinct())
    for _ in range(rounds):
        e = stashed(stars(stashed(stars(e, True)), False))
        # all are stars once each node has one leader that has none
        roles = e.select("node", F.lit(2).alias("role")).unionByName(e.select(F.col("leader").alias("node"), F.lit(1).alias("role")).distinct())
        if roles.groupBy("node").agg(F.sum("role").alias("roles")).where("roles > 2").isEmpty():
            return e
    raise RuntimeError(f"components not found in {rounds} rounds")


def _classed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """signatures of docs; and of each text its hash, class_id and kept, the class's row of the least id."""
    signed = stashed(signatures(docs))
    least = F.min(F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").cast("bigint").alias("doc_id"), F.col("hash"), F.col("row"))).alias("first")
    with passing(docs.sparkSession) as keep:  # all other tables are of no use afterwards
        # written, so that the joins by hash can split a large group of equal texts
        reps = stashed(signed.withColumn("hash", text_hash(F.col("doc.text"))).groupBy("hash").agg(F.min("row").alias("node"), least))
        by_text = stashed(named(reps, links(signed, reps), "node", "class"))
        first = stashed(by_text.groupBy("class").agg(F.min("first").alias("of_class")))
        return signed, keep(by_text.join(first, "class").select("hash", F.col("of_class.doc_id").alias("class_id"), F.col("of_class.row").alias("kept")))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id, the least id of its class, a row for each row of docs."""
    signed, by_text = _classed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return signed.select("doc.doc_id", text_hash(F.col("doc.text")).alias("hash")).join(by_text.select("hash", "class_id"), "hash").select("doc_id", "class_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class: that of the least id; of equal ids that of the least text hash, then the first as read."""
    signed, by_text = _classed(docs)
    keep = stashed(by_text.select(F.col("kept").alias("row")).distinct())
    return signed.join(keep.hint("merge"), "row", "left_semi").select("doc.*")
