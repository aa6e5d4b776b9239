"""Near-duplicate groups by bottom-k sketches of one hash function.

The k least hashes of a document's shingles are its sketch. Inverted lists of retained values bring documents together, the
union's sketch estimates their Jaccard similarity, and whole sets decide. Two linked documents share at least SHARED of
their retained values but for a chance below 1e-9, so that each document needs to be listed only under its rarest
k - SHARED + 1: a passage that many documents hold lists nobody who has enough else.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.functions.grouped import append, by_runs, pack, unpacked
from quirework.llm.groups import components
from quirework.session import cut

#: Values of a sketch.
K = 48
#: Members of a list that are compared by their sketches at once; longer lists are compared by whole sets, in blocks.
LONG = 64
#: Documents and shingles of a block, at most about.
BLOCK_DOCS, BLOCK_SHINGLES = 2048, 2_000_000
MEMO = 100_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def least_shared(k: int, percent: int, chance: float = 1e-9) -> int:
    """Of the k least values of two sets' union: how many both have, but for that chance, at a similarity of percent."""
    p, total = percent / 100, 0.0
    for x in range(k + 1):
        total += math.comb(k, x) * p**x * (1 - p) ** (k - x)
        if total > chance:
            return x
    return k


def listed(size: int, k: int = K, percent: int = 85) -> int:
    """Under how many of its retained values a document of that sketch size is listed."""
    whole = math.ceil(size * percent / 100)  # values that a set of this size shares with any linked set
    return max(1, size - min(whole, least_shared(k, percent)) + 1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: str | None, width: int = 3) -> np.ndarray:
    """The sorted 64-bit hashes of a text's different shingles; see near_duplicates()."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(words) < width:
        for x in range(len(words)):
            words[x] = h[x : x + 1]
        z = np.array([len(words)], np.uint64)
        for x in words:
            z = _mix(z + x)
        return z
    z = _mix(h[width - 1 :])
    for x in range(width - 2, -1, -1):
        z = _mix(h[x : len(h) - width + 1 + x] + z)
    return np.unique(z)


def _node(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _signed(s: np.ndarray) -> np.ndarray:
    return s.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text: str, width: int, k: int) -> DataFrame:
    """(_id, _mark, node, n, sketch): _mark is a hash of the text; node is 128 bits of the set, equal for equal sets; null for an empty one."""

    def found(texts: pa.Array) -> list[pa.Array]:
        nodes, sizes, kept = [], [], []
        for t in texts:
            s = shingles(t.as_py(), width)
            nodes.append(_node(s) if len(s) else None)
            sizes.append(len(s))
            kept.append(_signed(s[:k].copy()))
        return [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(kept, pa.list_(pa.int64()))]

    added = T.StructType.fromDDL("node binary, n long, sketch array<long>")
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_mark"), F.col(text).alias("_text"))
    return append(rows, "_text", added, found, ("_text",))


def _estimate(a: np.ndarray, b: np.ndarray, k: int) -> int:
    """How many of the k least values of the union both sketches have, out of min(k, values of the union)."""
    both = np.intersect1d(a, b, assume_unique=True)
    union = len(a) + len(b) - len(both)
    if union <= k:
        return len(both)
    last = np.partition(np.union1d(a, b), k - 1)[k - 1]
    return int(np.count_nonzero(both <= last))


def _short_lists(k: int, percent: int):
    """Pairs of one list that can be linked by their sizes and the sketch of their union."""
    need = least_shared(k, percent)

    def run(g: pd.DataFrame) -> pd.DataFrame | None:
        m = len(g)
        if m < 2:
            return None
        nodes, sizes = g["node"].to_numpy(), g["n"].to_numpy(np.int64)
        sk = [np.asarray(x, np.int64).view(np.uint64) for x in g["sketch"]]
        out = []
        for i in range(m):
            for j in range(i + 1, m):
                lo, hi = min(sizes[i], sizes[j]), max(sizes[i], sizes[j])
                if 100 * lo < percent * hi or nodes[i] == nodes[j]:
                    continue
                # sets that fit into their sketches are known whole
                shared = _estimate(sk[i], sk[j], k)
                if 100 * shared >= percent * (lo + hi - shared) if hi <= k and lo + hi - shared <= k else shared >= need:
                    out.append((nodes[i], nodes[j]))
        return pd.DataFrame(out, columns=["a", "b"]) if out else None

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify(width: int, percent: int):
    """Rows of one a: its own text (b null) first, then the texts of its candidates."""

    def run(g: pd.DataFrame) -> pd.DataFrame | None:
        own, out = None, []
        for a, b, t in zip(g["a"], g["b"], g["text"], strict=True):
            s = shingles(t, width)
            name = _node(s)
            if b is None:
                own = s if name == a else own
            elif own is not None and name == b and linked(own, s, percent):
                out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"]).drop_duplicates() if out else None

    return run


def _blocks(width: int, percent: int):
    """A forest of the links between the documents of two blocks of a long list, decided by whole sets."""

    def run(g: pd.DataFrame) -> pd.DataFrame | None:
        nodes, sets, side = [], [], []
        for node, t, mine in zip(g["node"], g["text"], g["mine"], strict=True):
            s = shingles(t, width)
            if _node(s) == node and (not nodes or nodes[-1] != node):
                nodes.append(node)
                sets.append(s)
                side.append(mine)
        m = len(nodes)
        if m < 2:
            return None
        order = np.argsort([len(s) for s in sets], kind="stable")
        nodes, sets, side = [nodes[i] for i in order], [sets[i] for i in order], np.array(side)[order]
        same = g["i"].iloc[0] == g["j"].iloc[0]
        sizes = np.array([len(s) for s in sets])
        values, at = np.unique(np.concatenate(sets), return_inverse=True)
        common = np.bincount(at) > 1  # a value of one document alone adds to no intersection
        starts = np.concatenate([[0], np.cumsum(sizes)])
        kept = [at[starts[i] : starts[i + 1]] for i in range(m)]
        kept = [x[common[x]] for x in kept]
        flat, begin = np.concatenate(kept), np.concatenate([[0], np.cumsum([len(x) for x in kept])])
        root = np.arange(m)
        flag, out = np.zeros(len(values), np.int8), []
        for i in range(m):
            j = int(np.searchsorted(sizes, sizes[i] * 100 // percent, side="right"))  # 100 * size(i) >= percent * size(j)
            lo = i + 1
            if j <= lo:
                continue
            other = root[lo:j] != root[i]
            if not same:
                other &= side[lo:j] != side[i]
            if not other.any():
                continue
            flag[kept[i]] = 1
            counts = np.concatenate([[0], np.cumsum(flag[flat[begin[lo] : begin[j]]], dtype=np.int64)])
            both = counts[begin[lo + 1 : j + 1] - begin[lo]] - counts[begin[lo:j] - begin[lo]]
            flag[kept[i]] = 0
            for x in np.flatnonzero(other & (100 * both >= percent * (sizes[i] + sizes[lo:j] - both))) + lo:
                if root[x] != root[i]:
                    out.append((nodes[i], nodes[x]))
                    root[root == root[x]] = root[i]
        return pd.DataFrame(out, columns=["a", "b"]) if out else None

    return run


def links(nodes: DataFrame, texts: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    """Links (a, b) between different sets that join whatever is to be joined: every one from short lists, a forest from long ones.

    nodes(node, id, n, sketch): a row per set. texts(_id, _text): where the text of a node's id is found.
    """
    size = F.size("sketch")
    entries = nodes.select("node", "n", size.alias("m"), F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    met = entries.join(shared, "value")
    # values that one document alone retains are the rarest; then by count
    rank = F.row_number().over(Window.partitionBy("node").orderBy("c", "value")) + F.col("m") - F.count(F.lit(1)).over(Window.partitionBy("node"))
    limit = F.element_at(F.array(*[F.lit(listed(x, k, percent)) for x in range(1, k + 1)]), F.col("m"))
    index = cut(met.withColumn("rank", rank).filter(F.col("rank") <= limit).select("value", "node", "n"))
    lists = index.groupBy("value").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("shingles")).filter("c > 1")
    index = cut(index.join(lists, "value"))

    short = index.filter(F.col("c") <= LONG).select("value", "node", "n")
    with_sketch = short.join(nodes.select(F.col("node").alias("_node"), "sketch"), F.col("node") == F.col("_node")).drop("_node")
    pairs = cut(by_runs(with_sketch, ["value"], ["node"], _short_lists(k, percent), "a binary, b binary").distinct())

    place = nodes.select(F.col("node").alias("_node"), F.col("id").alias("_place"))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    long = index.filter(F.col("c") > LONG)
    wanted = ends.union(long.select("node")).distinct().join(place, F.col("node") == F.col("_node")).select("node", "_place")
    found = cut(wanted.join(texts, F.col("_place").eqNullSafe(F.col("_id"))).select("node", F.col("_text").alias("text")))

    of = found.select(F.col("node").alias("_n"), "text")
    sides = pairs.join(of, F.col("b") == F.col("_n")).select("a", "b", "text")
    own = pairs.select("a").distinct().join(of, F.col("a") == F.col("_n")).select("a", F.lit(None).cast("binary").alias("b"), "text")
    near = by_runs(own.union(sides), ["a"], ["b"], _verify(width, percent), "a binary, b binary")

    blocks = F.greatest(F.ceil(F.col("c") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = long.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    dealt = dealt.join(of, F.col("node") == F.col("_n")).select("value", "i", "j", "mine", "node", "text")
    far = by_runs(dealt, ["value", "i", "j"], ["node"], _blocks(width, percent), "a binary, b binary")
    return near.union(far)


def _rooted(docs: DataFrame, id_col: str, text: str, width: int, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(_id, _mark, node, n) of every row, and (_node, root), the component of every set that isn't empty."""
    base = cut(sketches(docs, id_col, text, width, k))
    nodes = cut(base.filter("node IS NOT NULL").groupBy("node").agg(F.min("_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    roots = components(links(nodes, texts, width, percent, k))
    return base, nodes.select(F.col("node").alias("_node"), "id").join(roots, F.col("_node") == F.col("node"), "left").select("_node", "id", F.coalesce("root", "_node").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): a row for every row of docs.

    A-Z become lower case; words are runs without ASCII white space; a set holds the different shingles of `width` words, the
    whole text as one where there are fewer. Sets with 100 * intersection >= percent * union are linked. component_id is the
    least id that can be reached; kept says that it is the row's own. A text without words, or null, is linked with nothing.
    Rows of equal sets, repeated rows among them, are one node. A row without id is linked as others are; it never names a
    component, and is kept if no row with an id is in its component. Empty table: no rows.
    """
    base, named = _rooted(docs, id_col, text, width, percent, k)
    least = named.groupBy("root").agg(F.min("id").alias("least"))
    names = named.join(least, "root").select("_node", "least")
    out = base.join(names, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("least"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85, k: int = K) -> DataFrame:
    """docs with one row of each component of near_duplicates(), and the rows without words.

    The row with the least id stays (one without id where none has one); of rows with that id and different texts, which may
    stand in other components too, one text's; of rows equal in id and text, with words or without, one. So no row goes by its id alone, and no
    text of which there is no copy. Empty table: no rows.
    """
    base, named = _rooted(docs, id_col, text, width, percent, k)
    rows = base.join(named.select("_node", "root"), F.col("node") == F.col("_node")).select("root", F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_mark").alias("mark")).alias("row"))
    stays = rows.groupBy("root").agg(F.min("row").alias("first")).select("root", "first")
    # an id travels within a struct: equal to another where both are null, so that grouping and join share one shuffle of the rows
    gone = rows.join(stays, "root").filter(F.col("row") != F.col("first")).select("row.mark", F.struct("row.id").alias("of")).distinct()
    packed = pack(docs, mark=F.xxhash64(F.col(f"`{text}`")), of=F.struct(F.col(f"`{id_col}`").alias("id")))
    one = packed.groupBy("mark", "of").agg(F.first("row").alias("row"))
    # a row that is the first of its component is no other's: equal texts are of one component
    return one.join(gone, ["mark", "of"], "left_anti").select(*unpacked(docs.columns))
