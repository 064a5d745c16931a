"""Components of sets that link at an exact Jaccard threshold, from groups that share a key.

Shared by the set joins, which differ in their keys and in how they search a
group. A group's sets are first tested, exactly, against one of its members, a
linear number of tests; links contract the components. Groups that still hold
several components are searched by a ``search`` of the caller, each set outside
the group's main component against its best few candidates; what is left after
``ROUNDS`` of that has all its candidate pairs tested. Groups with the same
members are searched once, closed groups leave, and no step gathers a group of
over ``BLOCK`` sets in one task. Every link is an overlap of two full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .components import connected_components
from .stage import Scratch
from .vectors import join_back

#: Sets of a group that one task holds.
BLOCK = 1024
#: Rows of small groups that go to Python together, on average: a call for each group costs more than its pairs.
LOT_ROWS = 4000
#: Groups of so many sets or fewer are compared pair by pair, all groups of a task together.
SMALL = 8
PAIR_BLOCK = 1 << 15
#: Sets of more than so many tokens have a bitmap of a bit or two for each, as far as ``WIDEST``.
LARGE, WIDEST = 1024, 1 << 16
#: Bytes of full sets that one task holds, on average.
LOT_BYTES = 4 << 20
#: Rounds before all pairs are taken, and tests of one set in each: they only save work.
ROUNDS, TESTS = 1, 4
#: Sets that meet one set in one task, and sets (with their lots) of which a list is sent to all workers; more meet their lots by a shuffle.
TESTS_PER_SET, SENT_SETS = 1000, 500_000
#: Hashed ids (8 bytes each) that are sent to all workers; more meet the texts by a shuffle.
SENT_IDS = 1_000_000


class Search(Protocol):
    """Candidate search among the rows of a task."""

    def check(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs of rows that may link, and their likeness."""

    def across(self, a: np.ndarray, b: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in ``a`` and ``b`` (None: ``a`` again) of the pairs that may link, and their likeness."""


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def wide_bitmap(s: np.ndarray) -> bytes | None:
    """Bitmap of a large set, with a power of two of bits."""
    if len(s) <= LARGE:
        return None
    width = min(1 << (len(s) - 1).bit_length(), WIDEST)
    bits = np.zeros(width, np.uint8)
    bits[(s >> np.uint64(20)).astype(np.int64) % width] = 1
    return np.packbits(bits).tobytes()


def _most_common(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """The largest overlap that the wide bitmaps of two sets leave; the wider one is folded."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y, n_a, n_b = y, x, n_b, n_a
    y = np.bitwise_or.reduce(y.reshape(-1, len(x)))
    excess = min(n_a - int(np.bitwise_count(x).sum()), n_b - int(np.bitwise_count(y).sum()))
    return min(int(np.bitwise_count(x & y).sum()) + excess, n_a, n_b)


def shingle_sets(column, width: int):
    """Per chunk of texts: first text, hashes and bounds of the distinct shingle sets."""
    for chunk in words.word_chunks(column):
        hashes, bounds = words.shingle_hashes(chunk, width)
        yield chunk.first, *words.distinct_per_doc(hashes, bounds)


def _full_sets(width: int):
    def run(batches):
        for batch in batches:
            for _, hashes, bounds in shingle_sets(batch.column(0), width):
                rows = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in rows], pa.binary()), pa.array([s.tobytes() for s in rows], pa.binary())], names=["fp", "items"])

    return run, "fp binary, items binary"


def save_classes(signed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc, n, fp, keys, payload): all (doc, n, fp), and one numbered row (cls, fp, least, copies, n, keys, payload) for each fingerprint.

    Rows can have ``wide`` bitmaps of the large sets.
    """
    signed = scratch.save(signed, "signatures")
    scratch.release()
    same = signed.where("fp IS NOT NULL").groupBy("fp")
    one = same.agg(F.min("doc").alias("least"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "keys", "payload", "wide") if c in signed.columns])
    classes = scratch.save(one.withColumn("cls", F.monotonically_increasing_id()), "classes")
    rows = scratch.save(signed.select("doc", "n", "fp"), "rows")
    scratch.drop(signed)
    scratch.release()
    return rows, classes


def _lots(tests: DataFrame) -> DataFrame | None:
    """``tests`` with the lot whose task compares them, None if there are none.

    Tests of one bucket share their sets and stay together. A bucket with more
    than a lot holds is cut into slices of its sets, and two slices meet in a lot.
    """
    end = lambda s: tests.select("bucket", F.col(f"c{s}").alias("x"), F.col(f"n_{s}").alias("n"))
    sets = end("a").unionAll(end("b")).groupBy("bucket", "x", "n").agg(F.count("*").alias("k"))
    held = sets.groupBy("bucket").agg(F.count("*").alias("sets"), (F.sum("n") * 8).alias("bytes"), (F.sum(F.col("n") * F.col("k")) * 8).alias("most"))
    over = F.greatest(F.ceil(2 * F.col("bytes") / LOT_BYTES), F.ceil(F.col("sets") / TESTS_PER_SET))
    held = held.withColumn("slices", F.when((F.col("bytes") <= LOT_BYTES) & (F.col("sets") <= TESTS_PER_SET), 1).otherwise(over).cast("int"))
    sent = F.when(F.col("slices") == 1, F.col("bytes")).otherwise(F.least("most", F.col("bytes") * 2 * F.col("slices")))
    total, slices = held.agg(F.sum(sent), F.max("slices")).first()
    if total is None:
        return None
    part = [F.col("bucket")]
    if slices > 1:
        tests = tests.join(F.broadcast(held.where("slices > 1").select("bucket", "slices")), "bucket", "left")
        part += [F.pmod(F.xxhash64(c), F.coalesce("slices", F.lit(1))) for c in ("ca", "cb")]
    return tests.withColumn("lot", F.pmod(F.xxhash64(*part), F.lit(max(1, -(-total // LOT_BYTES)))).cast("int"))


def _full(tests: DataFrame, base: DataFrame, width: int, repeated: bool, scratch: Scratch) -> DataFrame:
    """(lot, fp, items) of the sets in ``tests``, made again from their texts: each once for a lot that needs it."""
    side = lambda s: tests.select(F.xxhash64(f"least_{s}").alias("id"), F.xxhash64(s).alias("code"), "lot")
    wanted = scratch.save(side("a").unionAll(side("b")).groupBy("id", "code").agg(F.collect_set("lot").alias("lots")), "wanted")
    count = wanted.count()
    sent = lambda df, most: F.broadcast(df) if count <= most else df
    run, schema = _full_sets(width)
    # an id with several texts, or a hash of two ids, gives sets that no test has
    sets = base.withColumn("id", F.xxhash64("doc")).join(sent(wanted.select("id").distinct(), SENT_IDS), "id", "left_semi").select("txt").mapInArrow(run, schema)
    if repeated:
        sets = sets.dropDuplicates(["fp"])
    return sets.withColumn("code", F.xxhash64("fp")).join(sent(wanted.select("code", "lots"), SENT_SETS), "code").select(F.explode("lots").alias("lot"), "fp", "items")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a binary column without nulls, not copied."""
    _, offsets, data = column.buffers()
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]


def _linked(num: int, den: int):
    """Of the tests (ca, cb, a, b) of a lot, the classes of those whose sets reach the threshold."""

    def run(sets: pa.Table, tests: pa.Table) -> pa.Table:
        data, at = _bytes(pa.chunked_array(sets.column("items").chunks, pa.binary()).combine_chunks())
        items = {fp: data[at[k] : at[k + 1]].view(np.uint64) for k, fp in enumerate(sets.column("fp").to_pylist())}
        keep = np.zeros(len(tests), bool)
        for k, (a, b) in enumerate(zip(tests.column("a").to_pylist(), tests.column("b").to_pylist(), strict=True)):
            both = np.concatenate((items[a], items[b]))
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            keep[k] = common * den >= (len(both) - common) * num
        return tests.select(["ca", "cb"]).filter(pa.array(keep)).rename_columns(["a", "b"])

    return run, "a long, b long"


def _plausible(pairs: DataFrame, active: DataFrame, make) -> DataFrame:
    """Of pairs of classes (a, b), those that the search leaves: far less is sent for that than full sets."""

    def run(batches):
        for pdf in batches:
            k = len(pdf)
            search = make(np.concatenate((pdf["n_a"], pdf["n_b"])), [*pdf["payload_a"], *pdf["payload_b"]], np.arange(2 * k))
            keep, _ = search.check(np.arange(k), np.arange(k) + k)
            yield pdf[["a", "b"]].iloc[np.sort(keep)]

    side = lambda s: active.select(F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("payload").alias(f"payload_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a long, b long")


def _far_apart(tests: DataFrame, wide: DataFrame, num: int, den: int) -> DataFrame:
    """``tests`` without the pairs of large sets whose wide bitmaps leave no link: a sixtieth of the full sets is sent for that."""
    large = F.least("n_a", "n_b") > LARGE

    def run(batches):
        for batch in batches:
            n_a, n_b, a, b = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "wide_a", "wide_b"))
            keep = [_most_common(x, i, y, j) * (num + den) >= num * (i + j) for i, j, x, y in zip(n_a, n_b, a, b, strict=True)]
            yield batch.drop_columns(["wide_a", "wide_b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: wide.select(F.col("cls").alias(f"c{s}"), F.col("wide").alias(f"wide_{s}"))
    left = tests.where(large).join(side("a"), "ca").join(side("b"), "cb").select(*tests.columns, "wide_a", "wide_b")
    return tests.where(~large).unionByName(left.mapInArrow(run, tests.schema))


def verified(pairs: DataFrame, active: DataFrame, base: DataFrame, width: int, num: int, den: int, repeated: bool, scratch: Scratch) -> DataFrame:
    """Saved pairs of classes (a, b), of those given the ones whose full sets reach the threshold.

    Full sets are what weighs, so that each goes once to the lot of its tests,
    not once with each test. A test's bucket is the smallest class that one of
    its two is tested with, which a family of copies has in common.
    """
    ends = pairs.select(F.col("a").alias("cls"), F.col("b").alias("other")).unionAll(pairs.select("b", "a"))
    near = active.drop("payload", "wide").join(ends.groupBy("cls").agg(F.least("cls", F.min("other")).alias("near")), "cls")
    side = lambda s: near.select(F.col("cls").alias(f"c{s}"), F.col("fp").alias(s), F.col("least").alias(f"least_{s}"), F.col("n").alias(f"n_{s}"), F.col("near").alias(f"near_{s}"))
    tests = pairs.select(F.col("a").alias("ca"), F.col("b").alias("cb")).join(side("a"), "ca").join(side("b"), "cb")
    tests = tests.where(f"n_a * {den} >= n_b * {num} AND n_b * {den} >= n_a * {num}").withColumn("bucket", F.least("near_a", "near_b")).drop("near_a", "near_b")
    if "wide" in active.columns:
        tests = _far_apart(tests, active.where("wide IS NOT NULL"), num, den)
    tests = scratch.save(tests, "tests")
    scratch.release()
    dealt = _lots(tests)
    if dealt is None:
        return scratch.save(scratch.spark.createDataFrame([], "a long, b long"), "links")
    sets = _full(dealt, base, width, repeated, scratch)
    run, schema = _linked(num, den)
    links = scratch.save(sets.groupBy("lot").cogroup(dealt.select("lot", "ca", "cb", "a", "b").groupBy("lot")).applyInArrow(run, schema), "links")
    scratch.drop(tests)
    return links


def _best(i: np.ndarray, j: np.ndarray, likeness: np.ndarray) -> np.ndarray:
    """Places of the ``TESTS`` likeliest pairs of each i."""
    order = np.lexsort((j, -likeness, i))
    first = np.concatenate(([True], i[order][1:] != i[order][:-1]))
    rank = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
    return order[rank < TESTS]


def _small_groups(search: Search, groups: list[np.ndarray]):
    """Pairs of rows that may link within groups of at most ``SMALL`` rows."""
    rows = np.concatenate(groups)
    own = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    for step in range(1, SMALL):
        i = np.flatnonzero(own[step:] == own[:-step])
        for a in range(0, len(i), PAIR_BLOCK):
            x, y = rows[i[a : a + PAIR_BLOCK]], rows[i[a : a + PAIR_BLOCK] + step]
            keep, _ = search.check(x, y)
            if len(keep):
                yield x[keep], y[keep]


def _task_pairs(make, every: bool):
    """Pairs (a, b) of classes to test, of the groups of one task.

    A group's rows are those of its main component (``block`` -1 where a task
    has the whole group) and the rest, which are compared with one another and
    with the main component, or only with the best of it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cls = pdf["cls"].to_numpy()
        comp = pd.factorize(pdf["comp"])[0]
        search = make(pdf["n"].to_numpy(), pdf["payload"], comp)
        main = pdf["in_main"].to_numpy()
        block, p, q = pdf["block"].to_numpy(), int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        found = []

        def emit(i, j):
            a, b = cls[i], cls[j]
            found.append(np.unique(np.stack((np.maximum(a, b), np.minimum(a, b)), axis=1), axis=0))

        key = pd.factorize(pdf["key"])[0]
        order = np.argsort(key, kind="stable")
        groups = np.split(order, np.flatnonzero(key[order][1:] != key[order][:-1]) + 1)
        if small := [g for g in groups if len(g) <= SMALL and p < 0]:
            for i, j in _small_groups(search, small):
                emit(i, j)
        for rows in groups:
            if len(rows) <= SMALL and p < 0:
                continue
            if p >= 0:
                meetings = [(rows[block[rows] == p], None if p == q else rows[block[rows] == q])]
            else:
                rest, core = rows[~main[rows]], rows[main[rows]]
                meetings = [(rest, core), (rest, None)] if every else [(rest, core)]
            for a, b in meetings:
                if not len(a) or (b is not None and not len(b)):
                    continue
                for i, j, likeness in search.across(a, b):
                    if not every:
                        best = _best(i, j, likeness)
                        i, j = i[best], j[best]
                    emit(a[i], (a if b is None else b)[j])
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _searched(groups: DataFrame, classes: DataFrame, make, every: bool, lots: int) -> DataFrame:
    """Distinct pairs to test of the groups of at most ``BLOCK`` sets, dealt in ``lots``."""
    rows = groups.withColumn("lot", F.pmod(F.xxhash64("least"), F.lit(lots))).withColumns({c: F.lit(-1) for c in ("block", "p", "q")})
    rows = rows.join(classes.select("cls", "n", "payload"), "cls")
    pairs = rows.select("key", "cls", "comp", "n", "payload", "in_main", "block", "p", "q", "lot").groupBy("lot").applyInPandas(_task_pairs(make, every), "a long, b long")
    return pairs.distinct()


def _blocks(groups: DataFrame, classes: DataFrame, make, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Distinct pairs to test of bigger groups, each task getting two blocks of sets.

    Sets that link have sizes in one or in two neighbouring classes of size, so
    a group falls apart into those first. Then blocks of the sets outside its
    main component meet one another and the blocks of the main component.
    """
    rows = groups.select("key", "cls", "comp", "in_main").join(classes.select("cls", "n", "payload"), "cls")
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num)) + 1e-9) if num < den else F.col("n")
    rows = rows.withColumn("size", F.explode(F.array(size, size + 1))).withColumn("key", F.xxhash64("key", "size"))
    counts = rows.groupBy("key").agg(F.count("*").alias("members"), F.count(F.when(~F.col("in_main"), 1)).alias("rest"))
    counts = counts.where("rest > 0 AND members > 1").select("key", "members", F.ceil(F.col("rest") / BLOCK).cast("int").alias("outer"), F.ceil((F.col("members") - F.col("rest")) / BLOCK).cast("int").alias("inner"))
    rows = join_back(rows, scratch.save(counts, "counts"), ["key"], "members", rows.count())
    spread = F.xxhash64("cls", F.lit("block"))
    block = F.when(F.col("in_main"), F.col("outer") + F.pmod(spread, F.greatest("inner", F.lit(1)))).otherwise(F.pmod(spread, "outer")).cast("int")
    last = F.when(F.col("in_main"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("key", "cls", "comp", "n", "payload", "in_main", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    return rows.groupBy("key", "p", "q").applyInPandas(_task_pairs(make, True), "a long, b long").distinct()


def _open(state: DataFrame, round_: int, scratch: Scratch) -> DataFrame:
    """Saved rows (key, cls, comp) of the groups with several components, with members, least, main, pick and in_main; of groups with the same members one."""
    one = F.xxhash64("cls")
    parts = state.groupBy("key", "comp").agg(
        F.count("*").alias("m"), F.min("cls").alias("least"), F.max_by("cls", F.xxhash64("cls", F.lit(round_))).alias("pick"), F.bit_xor(one).alias("x0"), F.bit_xor(F.xxhash64(F.lit("x"), "cls")).alias("x1")
    )
    groups = parts.groupBy("key").agg(
        F.count("*").alias("comps"), F.sum("m").alias("members"), F.min("least").alias("least"), F.max_by(F.struct("comp", "pick"), F.struct("m", "pick")).alias("main"), F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1")
    )
    groups = groups.where("comps > 1").groupBy("members", "x0", "x1").agg(F.min("key").alias("key"), *[F.min_by(c, "key").alias(c) for c in ("least", "main")])
    groups = scratch.save(groups.select("key", "least", "main", "members", F.col("members").alias("copies")), "groups")
    rows = join_back(state, groups, ["key"], "copies", state.count()).withColumn("in_main", F.col("comp") == F.col("main.comp"))
    rows = scratch.save(rows, "open")
    scratch.drop(groups)
    return rows


def _absorb(comp: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components after further links, by the components of the components."""
    old = comp.select("node", "component")
    ends = links.select("a", "b").join(old.toDF("a", "ca"), "a", "left").join(old.toDF("b", "cb"), "b", "left")
    over = connected_components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "a", "b", scratch)
    merged = old.join(over.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = over.toDF("node", "component").join(old, "node", "left_anti")
    return scratch.save(merged.unionByName(fresh), "components")


def _candidates(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (key, cls, least, members) of the keys of several classes; of keys with the very same classes one."""
    keyed = classes.select("cls", F.explode("keys").alias("key"))
    total = classes.agg(F.sum(F.size("keys"))).first()[0] or 0
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = scratch.save(shared, "keys")
    scratch.release()
    every = scratch.save(join_back(keyed, shared, ["key"], "members", total), "shared")
    groups = every.groupBy("key").agg(F.count("*").alias("members"), F.min("cls").alias("least"), F.bit_xor(F.xxhash64("cls")).alias("x0"), F.bit_xor(F.xxhash64(F.lit("x"), "cls")).alias("x1"))
    groups = groups.groupBy("members", "x0", "x1", "least").agg(F.min("key").alias("key"))
    groups = scratch.save(groups.select("key", "least", "members"), "groups")
    cands = scratch.save(join_back(every, groups, ["key"], "members", every.count()), "candidates")
    for done in (shared, every, groups):
        scratch.drop(done)
    scratch.release()
    return cands


def class_components(classes: DataFrame, base: DataFrame, width: int, make, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Rows (fp, component, copies): component is the smallest ``least`` that links reach from the class.

    ``classes`` as ``save_classes`` gives them, ``base`` the texts (doc, txt) they
    come from; ``make(n, payloads, comp)`` is the search of a task's rows.
    """
    spark = classes.sparkSession
    # where an id has several rows, a text can be read more than once
    repeated = not base.groupBy(F.xxhash64("doc")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    cands = _candidates(classes, scratch)
    comp = None
    if not cands.isEmpty():
        active = classes.join(cands.select("cls").distinct(), "cls", "left_semi")
        active = scratch.save(active.drop("copies", "keys"), "active")
        pairs = cands.where("cls <> least").groupBy("cls").agg(F.min("least").alias("b")).select(F.col("cls").alias("a"), "b")
        pairs = scratch.save(_plausible(pairs, active, make), "pairs")
        comp = _absorb(spark.createDataFrame([], "node long, component long"), verified(pairs, active, base, width, num, den, repeated, scratch), scratch)
        scratch.release()
        state = cands
        for round_ in range(ROUNDS + 1):
            now = state.select("key", "cls").join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("comp"))
            now = scratch.save(now, "members")
            groups = _open(now, round_, scratch)
            for done in (state, now):
                scratch.drop(done)
            state, rows, every = groups, groups.count(), round_ == ROUNDS
            if not rows:
                break
            pairs = _searched(groups.where(F.col("members") <= BLOCK), active, make, every, max(1, -(-rows // LOT_ROWS)))
            big = groups.where(F.col("members") > BLOCK)
            if every:
                pairs = pairs.unionByName(_blocks(big, active, make, num, den, scratch))
            else:
                # in a big group each set outside is tested against members of the main components
                tests = F.slice(F.sort_array(F.collect_set(F.struct(F.xxhash64("cls", "main.pick").alias("h"), F.col("main.pick").alias("b")))), 1, TESTS)
                far = big.where(~F.col("in_main")).groupBy("cls").agg(tests.alias("t"))
                pairs = pairs.unionByName(_plausible(far.select(F.col("cls").alias("a"), F.explode("t.b").alias("b")), active, make))
            pairs = scratch.save(pairs, "pairs")
            links = verified(pairs, active, base, width, num, den, repeated, scratch)
            before, comp = comp, _absorb(comp, links, scratch)
            for done in (pairs, links, before):
                scratch.drop(done)
            scratch.release()
    named = classes.select("cls", "fp", "least", "copies")
    if comp is None:
        return named.select("fp", F.col("least").alias("component"), "copies")
    named = scratch.save(named.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component"), "named")
    least = scratch.save(named.groupBy("comp").agg(F.min("least").alias("component"), F.count("*").alias("many")), "least")
    return join_back(named.select("fp", "copies", "comp"), least, ["comp"], "many", named.count()).select("fp", "component", "copies")


def to_rows(signed: DataFrame, named: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (doc, n, component, copies) of ``signed``; those without a set are alone."""
    named = scratch.save(named.withColumn("class_size", F.col("copies")), "classes-named")
    out = join_back(signed.where("fp IS NOT NULL").select("doc", "n", "fp"), named, ["fp"], "copies", signed.count())
    alone = signed.where("fp IS NULL").select("doc", "n", F.col("doc").alias("component"), F.lit(1).cast("long").alias("class_size"))
    return out.select("doc", "n", "component", "class_size").unionByName(alone)
