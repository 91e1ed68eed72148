"""Jaccard join of word shingles: prefix filters under several token orders, then exact counts.

Equal sets are one node. If two sets have a similarity of at least t, they share a token among the
first n - ceil(t * n) + 1 of each set under ANY order of all tokens. All orders used here put
frequent tokens last (by a count per hash bucket over all documents, a table of fixed size), and
differ inside a frequency class. Postings of the first order's prefixes give pairs. Before whole sets
move, a pair's marks must allow its link: each set has a bit at a place of each of its tokens, and
a place that only one of two sets marks is a token that the other lacks, so marks bound the
intersection from above. What is left must share a prefix token under each other order, then its
sets are counted.

A token of many nodes does not become all pairs of them. Its list gets the least node as a leader,
every member is measured against it, and the rest follows from the triangle inequality of the
Jaccard distance: members near the leader are compared among each other inside tasks, by what they
lack and add beside the leader, in blocks, and a spanning forest of the links leaves the task, so a
group's links do not grow with its square; members further away
go on in a list without the leader and the near ones. Lists of at most ``SHORT`` nodes are paired,
and so is, by a join on the token, what is left in long lists after two rounds: nodes that share a
token and are unlike two leaders.

Links between members that both link with the leader say nothing new for components; they are left
out. Components are then found by joins (``components.py``).

Texts without words have the empty set: they link with nothing and are their own component. A null
text is such a text. Rows with equal sets are linked. A component is named by its smallest id; null
ids name none, so a component of null ids has a null name. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.llm.components import connected
from sparkmeter.llm.expressions import table
from sparkmeter.llm.registry import query
from sparkmeter.llm.words import chunks, mix, shingle_sets
from sparkmeter.session import Scratch, bound_batches, settle

WORDS, PERCENT = 5, 80
#: Buckets of the token counts: their number is fixed, so they may be sent to every task.
BUCKETS = 1 << 16
#: Bits of the filter for rows whose sets are asked for, a fixed 2 MB; hits are joined exactly.
BITS = 1 << 24
#: Bytes of a token in a set that is sent to be counted.
TOKEN_BYTES = 6
#: Places of a set's marks for each of its tokens, before the next power of two.
MARK_PLACES = 4
#: Longest list whose nodes are paired with each other.
SHORT = 32
#: Members of a leader's list that one task compares with those of another block.
BLOCK = 512
ORDERS = 3


def needed(n: int, percent: int) -> int:
    """The prefix length of a set of ``n`` tokens."""
    return n - -(-percent * n // 100) + 1


def _name(tokens: np.ndarray) -> bytes:
    """A 128-bit name of a set: sums of two spreads of its tokens, and its size."""
    if not len(tokens):
        return b""
    parts = [int(mix(tokens, k).sum(dtype=np.uint64)) ^ len(tokens) for k in (21, 22)]
    return b"".join(p.to_bytes(8, "big") for p in parts)


def _node(tokens: np.ndarray) -> int:
    """The second half of the name, by which sets are grouped before they are compared."""
    return int.from_bytes(_name(tokens)[8:], "big", signed=True)


def _set_rows(words: int):
    """(doc_id, key, name, node, n, bucket, count): a row per text, then the bucket counts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "name", "node", "n", "bucket", "count"]
        totals = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = list(shingle_sets(part.column("text"), words))
                totals += np.bincount(_bucket(np.concatenate(sets)), minlength=BUCKETS)
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("key"),
                        pa.array([_name(x) for x in sets], pa.binary()),
                        pa.array([_node(x) for x in sets], pa.int64()),
                        pa.array([len(x) for x in sets], pa.int64()),
                        none,
                        none,
                    ],
                    names=names,
                )
        used = np.flatnonzero(totals)
        if len(used):
            none = pa.nulls(len(used), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, pa.nulls(len(used), pa.binary()), none, none, pa.array(used), pa.array(totals[used])],
                names=names,
            )

    return run


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def prefix(tokens: np.ndarray, ranks: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first tokens of a set under one order: by frequency class, then by a spread."""
    spread = mix(tokens, 40 + order)
    length = needed(len(tokens), percent)
    first = np.lexsort((spread, ranks[_bucket(tokens)]))[:length]
    return tokens[first]


def _hit(part: pa.RecordBatch, bits: Broadcast) -> pa.RecordBatch:
    """The rows whose bit is set."""
    bit = part.column("bit").to_numpy(zero_copy_only=False)
    hit = (bits.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0
    return part.filter(pa.array(hit))


def _postings(words: int, percent: int, ranks: Broadcast, bits: Broadcast):
    """(token, node, n): the first order's prefix of each set that can link with another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(_hit(batch, bits), "text"):
                tokens, nodes, sizes = [], [], []
                for own in shingle_sets(part.column("text"), words):
                    if _links_possible(len(own), percent):
                        found = prefix(own, ranks.value, 0, percent)
                        tokens.append(found)
                        nodes += [_node(own)] * len(found)
                        sizes += [len(own)] * len(found)
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(tokens).view(np.int64)),
                            pa.array(nodes, pa.int64()),
                            pa.array(sizes, pa.int64()),
                        ],
                        names=["token", "node", "n"],
                    )

    return run


def _sized(lists: DataFrame) -> DataFrame:
    """Lists of two rows at least, with their length and their least node (and its size)."""
    sizes = lists.groupBy("token").agg(
        F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("least")
    )
    return lists.join(sizes.filter(F.col("size") > 1), "token")


def _links_possible(n: int, percent: int) -> bool:
    """Whether a set of ``n`` tokens can link with a different set (n of n + 1 tokens at best)."""
    return 100 * n >= percent * (n + 1)


def _packed(tokens: np.ndarray) -> bytes:
    """The leading bytes of each token, in order."""
    return tokens.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // TOKEN_BYTES, 8), dtype=np.uint8)
    out[:, 8 - TOKEN_BYTES :] = np.frombuffer(data, dtype=np.uint8).reshape(-1, TOKEN_BYTES)
    return out.view(">u8").ravel().astype(np.uint64)


def _marks(tokens: np.ndarray) -> bytes:
    """A bit at each token's place, which is its last bits: as many as the size of the set asks for."""
    places = 64
    while places < MARK_PLACES * len(tokens):
        places *= 2
    marked = np.zeros(places, dtype=bool)
    marked[(tokens & np.uint64(places - 1)).astype(np.int64)] = True
    return np.packbits(marked).tobytes()


def _most_shared(a: bytes, b: bytes, na: int, nb: int) -> int:
    """An upper bound of the intersection of two sets, by their marks and sizes."""
    one, two = (np.frombuffer(x, dtype=np.uint64) for x in (a, b))
    while len(one) > len(two):
        one = one[: len(one) // 2] | one[len(one) // 2 :]
    while len(two) > len(one):
        two = two[: len(two) // 2] | two[len(two) // 2 :]
    own = [int(np.bitwise_count(x & ~y).sum()) for x, y in ((one, two), (two, one))]
    return min(na - own[0], nb - own[1])


def _sketches(words: int, bits: Broadcast):
    """(node, n, marks) of the texts that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(_hit(batch, bits), "text"):
                rows = [(_node(x), len(x), _marks(x)) for x in shingle_sets(part.column("text"), words)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
                kinds = [pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "n", "marks"]
                )

    return run


def _details(words: int, percent: int, ranks: Broadcast, bits: Broadcast):
    """(node, name, tokens, others) of the texts that pass the filter; others: the other orders' prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(_hit(batch, bits), "text"):
                nodes, names, sets, others = [], [], [], []
                for own in shingle_sets(part.column("text"), words):
                    nodes.append(_node(own))
                    names.append(_name(own))
                    sets.append(_packed(own))
                    others.append(
                        b"".join(_packed(np.sort(prefix(own, ranks.value, k, percent))) for k in range(1, ORDERS))
                    )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), *[pa.array(c, pa.binary()) for c in (names, sets, others)]],
                    names=["node", "name", "tokens", "others"],
                )

    return run


def _sets_of(column: pa.Array) -> list[np.ndarray]:
    return [_unpacked(v.as_py()) for v in column]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def _possible(percent: int):
    """(a, b, lead): pairs whose marks allow a link, or with a leader that they are near it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            columns = [batch.column(c).to_pylist() for c in ("ma", "mb", "na", "nb", "lead")]
            for ma, mb, na, nb, lead in zip(*columns, strict=True):
                most = _most_shared(ma, mb, na, nb)
                keep.append(_near(most, na, nb, percent) if lead else 100 * most >= percent * (na + nb - most))
            kept = pa.array(keep, pa.bool_())
            names = ["a", "b", "lead"]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(kept) for c in names], names=names)

    return run


def _share_prefixes(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets share a prefix token under every other order."""
    one, two = np.split(a, ORDERS - 1), np.split(b, ORDERS - 1)
    return all(_shared(x, y) for x, y in zip(one, two, strict=True))


def _measured(percent: int):
    """(a, b, an, bn, shared, na, nb, lacks, adds): exact counts; what b lacks of a and adds to it.

    Pairs that share no prefix token under another order go, but for those with a leader: their
    distance is needed even where it is large.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leads = batch.column("lead").to_pylist()
            others = zip(_sets_of(batch.column("oa")), _sets_of(batch.column("ob")), leads, strict=True)
            kept = pa.array([lead or _share_prefixes(a, b) for a, b, lead in others], pa.bool_())
            batch = batch.filter(kept)
            rows = []
            pairs = zip(
                _sets_of(batch.column("ta")), _sets_of(batch.column("tb")), batch.column("lead").to_pylist(), strict=True
            )
            for a, b, lead in pairs:
                shared = _shared(a, b)
                near = lead and _near(shared, len(a), len(b), percent)
                lacks = np.setdiff1d(a, b, assume_unique=True).tobytes() if near else None
                adds = np.setdiff1d(b, a, assume_unique=True).tobytes() if near else None
                rows.append((shared, len(a), len(b), lacks, adds))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("a", "b", "an", "bn")], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=["a", "b", "an", "bn", "shared", "na", "nb", "lacks", "adds"],
            )

    return run


#: Distance to the leader up to which members leave its list.
RADIUS = 0.6
#: Rounds with leaders; what is still in long lists after them is unlike its leaders and paired.
LED_ROUNDS = 2


def _reach(percent: int) -> float:
    """Distance to the leader up to which members are compared with each other."""
    return RADIUS + (1 - percent / 100) + 1e-9


def _near(shared: int, na: int, nb: int, percent: int) -> bool:
    """Whether a member is compared with the leader's other near members.

    Let r be the radius. A member within r can only link with members within r + (1 - t).
    """
    return 1 - shared / (na + nb - shared) <= _reach(percent)


def _links_in_blocks(percent: int):
    """Links among members of two blocks of one leader's list, by their differences from it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["side"] <= 1], group[group["side"] >= 1]
        return pd.DataFrame(_block_links(left, right, percent), columns=["a", "b"])

    return run


def _block_links(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> list[tuple[bytes, bytes]]:
    out: list[tuple[bytes, bytes]] = []
    if not len(left) or not len(right):
        return out
    both = [left, right]
    sizes = [f["nb"].to_numpy() for f in both]
    linked = [f["linked"].to_numpy() for f in both]
    na = int(left["na"].iloc[0])
    lack_counts = [f["lacks"].map(len).to_numpy() // 8 for f in both]
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    total += na - lack_counts[0][:, None] - lack_counts[1][None, :]
    for field in ("lacks", "adds"):
        total += _overlaps(*[[np.frombuffer(v, dtype=np.uint64) for v in f[field]] for f in both])
    union = sizes[0][:, None] + sizes[1][None, :] - total
    hit = (100 * total >= percent * union) & ~(linked[0][:, None] & linked[1][None, :])
    return _forest(hit, *[f["bn"].tolist() for f in both], *linked)


def _forest(
    hit: np.ndarray, left: list[bytes], right: list[bytes], left_linked: np.ndarray, right_linked: np.ndarray
) -> list[tuple[bytes, bytes]]:
    """Of the links in a block, as few as join the same members; the leader joins the linked ones."""
    number = {name: k + 1 for k, name in enumerate(dict.fromkeys([*left, *right]))}
    rows, columns = (np.array([number[x] for x in names]) for names in (left, right))
    label = np.arange(len(number) + 1)
    label[rows[left_linked]] = label[columns[right_linked]] = 0
    out = []
    for i, own in enumerate(rows):
        near = np.flatnonzero(hit[i])
        others, first = np.unique(label[columns[near]], return_index=True)
        for other, k in zip(others, first, strict=True):
            if other != label[own]:
                out.append((left[i], right[near[k]]))
                label[label == other] = label[own]
    return out


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, through an index of common tokens."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    flat = [np.concatenate([*s, np.zeros(0, dtype=np.uint64)]) for s in (left, right)]
    owner = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    common = np.intersect1d(flat[0], flat[1])
    step = 4096
    for start in range(0, len(common), step):
        some = common[start : start + step]
        marks = []
        for tokens, rows, count in zip(flat, owner, (len(left), len(right)), strict=True):
            at = np.searchsorted(some, tokens)
            at[at == len(some)] = 0
            hit = some[at] == tokens
            mark = np.zeros((count, len(some)), dtype=np.float32)
            mark[rows[hit], at[hit]] = 1
            marks.append(mark)
        out += np.rint(marks[0] @ marks[1].T).astype(np.int64)
    return out


class Join:
    """One run over a table of (doc_id, key, text) rows, where equal texts have equal keys."""

    def __init__(self, texts: DataFrame, words: int, percent: int) -> None:
        self.spark, self.texts = texts.sparkSession, texts
        self.words, self.percent = words, percent
        bound_batches(self.spark)
        rows = settle(
            texts.select("doc_id", "key", "text").mapInArrow(
                _set_rows(words), "doc_id long, key long, name binary, node long, n long, bucket long, count long"
            ),
            "sets",
        )
        self.nodes = rows.filter("bucket IS NULL").select(
            "doc_id", "key", "name", "node", "n"
        )
        counts = rows.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("count").alias("n"))
        ranks = np.zeros(BUCKETS, dtype=np.uint8)
        found = counts.toArrow()  # a fixed number of buckets
        ranks[found.column("bucket").to_numpy()] = (4 * np.log2(found.column("n").to_numpy())).astype(int)
        self.ranks = self.spark.sparkContext.broadcast(ranks)
        self.held: list[Broadcast] = []

    def lists(self, drop: Scratch) -> DataFrame:
        """(token, node, n, size, least) of the first order, of tokens with two postings at least.

        Only the first text of each node is read; the few nodes that come twice by chance make a
        list longer than it is and are told apart where pairs are made.
        """
        able = self.nodes.filter(F.col("n") * 100 >= (F.col("n") + 1) * self.percent)
        postings = drop.settle(
            self._asked(able).mapInArrow(
                _postings(self.words, self.percent, self.ranks, self.held[-1]),
                "token long, node long, n long",
            ),
            "postings",
        )
        self._release()
        sized = drop.settle(_sized(postings), "sized")
        drop.drop(kept=1)
        return sized

    def sketches(self, names: DataFrame) -> DataFrame:
        """(node, n, marks) of some nodes, each from its first text, as in ``details``."""
        found = self._asked(self.nodes.join(names, "node", "left_semi")).mapInArrow(
            _sketches(self.words, self.held[-1]), "node long, n long, marks binary"
        )
        return found.dropDuplicates(["node"])

    def details(self, names: DataFrame) -> DataFrame:
        """(node, name, tokens, others) of some nodes, each from its first text.

        The texts are not shuffled: a bitmap of fixed size tells most rows that are not asked for,
        and a join with the asked nodes drops the others.
        """
        found = self._asked(self.nodes.join(names, "node", "left_semi")).mapInArrow(
            _details(self.words, self.percent, self.ranks, self.held[-1]),
            "node long, name binary, tokens binary, others binary",
        )
        # Repeated rows, and rows that meet a bit by chance, bring a node again.
        return found.dropDuplicates(["node"])

    def _asked(self, nodes: DataFrame) -> DataFrame:
        """(bit, text) of all texts, and the bits of the first text of each of some nodes."""
        first = nodes.groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("w"))
        bit = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BITS))
        marks = first.select(bit("w.doc_id", "w.key").alias("bit")).groupBy(
            F.shiftright("bit", 6).alias("word")
        )
        one = F.lit(1).cast("bigint")
        mark = F.call_function("shiftleft", one, F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
        words = marks.agg(F.bit_or(mark).alias("b")).toArrow()  # a fixed number of words
        bits = np.zeros(BITS // 64, dtype=np.uint64)
        bits[words.column("word").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
        self.held.append(self.spark.sparkContext.broadcast(bits))
        return self.texts.select(bit("doc_id", "key").alias("bit"), "text")

    def _release(self) -> None:
        """Drop the filters of steps that are written."""
        for held in self.held:
            held.destroy()
        self.held = []

    def linked(self, shared: Column, na: Column, nb: Column) -> Column:
        return shared * 100 >= (na + nb - shared) * self.percent

    def _with_sides(self, pairs: DataFrame, asked: Callable[[DataFrame], DataFrame], **columns: str) -> DataFrame:
        """Pairs with columns of both sides, named by a pattern with the side at its question mark."""
        both = pairs.select("a").unionAll(pairs.select("b")).select(F.col("a").alias("node")).distinct()
        found = asked(both)
        for side in ("a", "b"):
            own = [F.col(column).alias(pattern.replace("?", side)) for column, pattern in columns.items()]
            pairs = pairs.join(found.select(F.col("node").alias(side), *own), side)
        return pairs

    def measure(self, pairs: DataFrame, drop: Scratch) -> DataFrame:
        """Exact counts of pairs (a, b, lead) that pass the marks and the other orders' prefix filters.

        Pairs with a leader skip the prefixes and are left out where they are not near it.
        """
        marked = self._with_sides(pairs, self.sketches, marks="m?", n="n?")
        possible = drop.settle(
            marked.select("a", "b", "lead", "ma", "mb", "na", "nb").mapInArrow(
                _possible(self.percent), "a long, b long, lead boolean"
            ),
            "possible",
        )
        self._release()
        measured = (
            self._with_sides(possible, self.details, tokens="t?", others="o?", name="?n")
            .select("a", "b", "an", "bn", "lead", "ta", "tb", "oa", "ob")
            .mapInArrow(
                _measured(self.percent),
                "a long, b long, an binary, bn binary, shared long, na long, nb long, lacks binary, adds binary",
            )
        )
        out = drop.settle(measured, "measured")
        self._release()
        return out

    def short_pairs(self, lists: DataFrame) -> DataFrame:
        """Pairs of nodes in one short list, sizes apart at most as the threshold allows."""
        rows = lists.groupBy("token").agg(F.sort_array(F.collect_set(F.struct("node", "n"))).alias("l"))

        def beside(x: Column, i: Column) -> Column:
            rest = F.slice(F.col("l"), i + 2, F.size("l"))
            fits = lambda y: (
                F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * self.percent
            )
            return F.transform(
                F.filter(rest, fits), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"))
            )

        pairs = F.flatten(F.transform("l", beside))
        return rows.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()

    def long_pairs(self, lists: DataFrame) -> DataFrame:
        """All pairs of a list that fit in size, as a join that adaptive execution may split."""
        right = lists.select("token", F.col("node").alias("b"), F.col("n").alias("m"))
        fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * self.percent
        pairs = lists.join(right, "token").filter((F.col("node") < F.col("b")) & fits)
        return pairs.select(F.col("node").alias("a"), "b").distinct().withColumn("lead", F.lit(False))

    def links(self) -> DataFrame:
        """(a, b) links that join all nodes of each component."""
        spark = self.spark
        tables, work = Scratch(spark), Scratch(spark)
        sized = self.lists(tables)
        found: list[DataFrame] = []
        for turn in range(LED_ROUNDS + 1):
            short = sized.filter(F.col("size") <= SHORT).select("token", "node", "n")
            long = sized.filter(F.col("size") > SHORT).select(
                "token", "node", "n", F.col("least.node").alias("lead"), F.col("least.n").alias("lead_n")
            )
            if turn == LED_ROUNDS:
                rest = self.measure(work.settle(self.long_pairs(long), "pairs"), work)
                found.append(self._links_of(rest))
                work.drop()
                long = long.limit(0)
            # Sizes alone put a member outside of what is compared below.
            close = F.least("n", "lead_n") >= (1 - _reach(self.percent)) * F.greatest("n", "lead_n")
            pairs = self.short_pairs(short).withColumn("lead", F.lit(False))
            led = (
                long.filter((F.col("node") != F.col("lead")) & close)
                .select(F.col("lead").alias("a"), F.col("node").alias("b"))
                .distinct()
                .withColumn("lead", F.lit(True))
            )
            measured = self.measure(work.settle(pairs.unionAll(led), "pairs"), work)
            work.drop(kept=1)
            found.append(self._links_of(measured))
            if turn == LED_ROUNDS or long.isEmpty():
                break
            found.append(settle(self.near_links(measured.filter("lacks IS NOT NULL")), "near"))
            inside = measured.filter(
                1 - F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")) <= RADIUS
            ).select(F.col("a").alias("lead"), F.col("b").alias("node"))
            far = long.filter("node <> lead").join(inside, ["lead", "node"], "left_anti")
            # Nodes that came twice by chance do so once here.
            lists = work.settle(far.select("token", "node", "n").distinct(), "far")
            sized = tables.settle(_sized(lists), "sized")
            tables.drop(kept=1)
            work.drop()
        work.drop()
        tables.drop()
        out = found[0]
        for more in found[1:]:
            out = out.unionAll(more)
        return out

    def _links_of(self, measured: DataFrame) -> DataFrame:
        """The measured pairs that link, written by themselves."""
        hit = self.linked(F.col("shared"), F.col("na"), F.col("nb"))
        return settle(
            measured.filter(hit).select(F.col("an").alias("a"), F.col("bn").alias("b")), "linked"
        )

    def near_links(self, near: DataFrame) -> DataFrame:
        """Links among the near members of each leader that do not both link with it."""
        members = near.withColumn("linked", self.linked(F.col("shared"), F.col("na"), F.col("nb")))
        blocks = members.groupBy("an").agg(
            F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"), F.min("linked").alias("all_linked")
        )
        placed = members.join(blocks.filter("NOT all_linked"), "an").withColumn(
            "own", F.pmod(F.xxhash64("bn"), F.col("blocks"))
        )
        others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
        # side 0: left block, 2: right block, 1: both, when a block meets itself.
        dealt = placed.select("*", others).select(
            "an", "bn", "na", "nb", "lacks", "adds", "linked",
            F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            F.when(F.col("own") == F.col("other"), 1).when(F.col("own") < F.col("other"), 0).otherwise(2).alias("side"),
        )
        return dealt.groupBy("an", "i", "j").applyInPandas(
            _links_in_blocks(self.percent), "a binary, b binary"
        )


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """Rows of ``docs`` as (doc_id, n_shingles, component_id), with ``root`` and ``key``.

    ``root`` names the component also where its ids are null, ``key`` is a hash of the text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("key"), body.alias("text")
    )
    join = Join(keyed, words, percent)
    roots = settle(connected(join.links()), "roots")
    ids = join.nodes.drop("node").withColumnRenamed("name", "node")
    names = ids.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = names.join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), "least"
    )
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(groups, "root").select("node", "root", "component_id")
    named = ids.join(found, "node", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return named.select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "root", "key"
    )


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row of each component: its smallest id, among equal ids the least text hash.

    Rows without words are no duplicates of others; equal rows become one row. All columns are kept,
    whatever their names.
    """
    found = similar_documents(docs, id_col, text, words, percent)
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = first.filter("n_shingles > 0").groupBy("root").agg(
        F.min(F.struct("doc_id", "key")).alias("w")
    ).select("w.doc_id", "w.key")
    kept = kept.unionAll(first.filter("n_shingles = 0").select("doc_id", "key").distinct())
    held = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).alias("own_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("own_key"),
    )
    # The keys of the join are columns, so that equal rows are found where the join put them.
    sides = [
        (held.withColumn("given", F.col("own_id").cast("bigint")), "own_key"),
        (kept.withColumn("given", F.col("doc_id")), "key"),
    ]
    rows, wanted = (
        x.withColumns({"placed": F.col(key), "known": F.coalesce("given", F.lit(0)), "none": F.isnull("given")})
        for x, key in sides
    )
    by = ["placed", "known", "none"]
    return rows.join(wanted.select(*by), by, "left_semi").dropDuplicates([*by, "own_id"]).select("row.*")


@query("op6_multi_order_jaccard")
def op6_multi_order_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_documents(table(spark, sf_dir, "documents"), words=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")
