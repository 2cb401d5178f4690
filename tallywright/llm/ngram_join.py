"""Documents linked by the Jaccard similarity of their word shingles."""

from __future__ import annotations

from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import tables, textops
from tallywright.llm.components import components
from tallywright.session import ship

ship(__name__)

WORDS = 5
PERCENT = 80
_NO_ID = -(1 << 63)
_COLLISION_COST = 10.0
_NO_WORD = np.uint64(0x1234567)
_CELLS = 1 << 20
GROUP_ROWS = 2048  # members on either side of a comparison in one task
_CROWD = 16  # blocks outside the largest component from which a second signature pays
_SECOND = np.uint64(0xA5A5)
_BATCH = "16m"  # sets and sketches in Python at a time
TURNS = 4  # parts of the largest shuffles, one on disk at a time
_SLICE = 1 << 19  # bytes of text whose sets a worker makes at a time


def shingle_sets(content: np.ndarray, bounds: np.ndarray, width: int):
    """Distinct shingles of all texts, ascending in each, and where each set starts.

    A text with fewer words has its whole sequence as the only one, if it has any.
    """
    content = textops.LOWER[content]
    starts, ends, before = textops.words(content, bounds)
    code = textops.Hasher(content).of(starts, ends)
    count = np.diff(before)
    size = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(count)), size)
    first = before[owner] + np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
    padded = np.concatenate([code, np.zeros(width, np.uint64)])
    value = np.zeros(len(first), np.uint64)
    for step in range(width):
        at = first + step
        word = np.where(at < before[owner + 1], padded[at], _NO_WORD)
        value = textops.mix(value * np.uint64(0x9E3779B97F4A7C15) + word)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(count) + 1))


class Bands:
    """Bands of set sizes and how many differences their segments must bear.

    A band ends where the partner of its smallest set ends, so linked sets lie in the
    same band or in neighbouring ones.
    """

    def __init__(self, percent: int) -> None:
        self.percent, self.first = percent, [1]
        self._plans: dict[int, tuple[int, int, int]] = {}

    def of(self, size: int) -> int:
        while self.first[-1] <= size:
            self.first.append(self.first[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.first, size, side="right")) - 1

    def plan(self, band: int) -> tuple[int, int, int]:
        """Most differences, number of segments, and how many of them bear one.

        Segments that bear a difference also have every one-deletion as a signature.
        The values of all segments together exceed the most differences, with one to
        spare for an empty segment. Of all ways the cheapest is taken: a signature
        counts one, and segments with few tokens cost by their chance collisions.
        """
        if band in self._plans:
            return self._plans[band]
        self.of(self.first[band])
        largest = self.first[band + 1] - 1
        partner = largest * 100 // self.percent
        most = (100 - self.percent) * (largest + partner) // (100 + self.percent)
        need = most + 1 + (most >= 4)

        def cost(double: int) -> float:
            parts = need - double
            tokens = largest / parts
            return parts + double * tokens + _COLLISION_COST * parts * exp(-tokens / 2)

        double = min(range(need // 2 + 1), key=cost) if need < 64 else min((0, need // 2), key=cost)
        self._plans[band] = most, need - double, double
        return self._plans[band]


def _signatures(tokens: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures of one set (ascending tokens) in its own band and the one below."""
    own, out = bands.of(len(tokens)), []
    weights = textops.mix(tokens)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(weights, dtype=np.uint64)])
    for band in {own, max(own - 1, 0)}:
        most, parts, double = bands.plan(band)
        part = ((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        edge = np.searchsorted(part, np.arange(parts + 1))
        size = np.diff(edge)
        salt = textops.mix((np.uint64(band) << np.uint64(40)) + np.arange(parts, dtype=np.uint64))
        total = sums[edge[1:]] - sums[edge[:-1]]
        bears = np.arange(parts) < double
        value = np.minimum(size, 1 + bears)
        whole = value.sum() <= most  # too many empty segments: they count as well
        out.append(textops.mix(total + salt)[whole | (size > 0)])
        loses = bears[part] & (whole | (size[part] > 1))
        out.append(textops.mix(total[part] - weights + salt[part])[loses])
    return np.unique(np.concatenate(out))


def _fingerprinted(docs: DataFrame, width: int, percent: int) -> DataFrame:
    def run(batches):
        bands = Bands(percent)
        for batch in textops.slices(batches, size=_SLICE):
            values, edges = shingle_sets(*textops.flat(batch.column("text")), width)
            mixed = [
                np.concatenate([[np.uint64(0)], np.cumsum(textops.mix(values ^ np.uint64(s)), dtype=np.uint64)])
                for s in (0, 77)
            ]
            one, two = (m[edges[1:]] - m[edges[:-1]] for m in mixed)
            found = [_signatures(values[a:b], bands) if b > a else values[:0] for a, b in zip(edges[:-1], edges[1:])]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            joined = np.concatenate(found) if found else values[:0]
            sketches = [_sketch(values[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(edges)),
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(joined.view(np.int64))),
                    pa.array(sketches, pa.binary()),
                ],
                ["doc_id", "n", "one", "two", "signatures", "sketch"],
            )

    return docs.mapInArrow(
        run,
        "doc_id bigint, n bigint, one bigint, two bigint, signatures array<bigint>, sketch binary",
    )


def _shared(signatures: DataFrame) -> DataFrame:
    """The rows whose signature occurs again: signature, doc_id, and its least doc_id.

    One shuffle; a task streams its rows in order, however often a signature occurs.
    """
    count = tables.parallelism(signatures)

    def run(batches):
        last = None  # the row before, whether it was given out, and its group's least
        for batch in batches:
            s, d = batch.column("signature").to_numpy(), batch.column("doc_id").to_numpy()
            if not len(s):
                continue
            given = True
            if last is not None:
                s = np.concatenate([[last[0]], s])
                d = np.concatenate([[last[1]], d])
                given = last[2]
            same = s[1:] == s[:-1]
            start = np.concatenate([[True], ~same])
            hub = d[np.maximum.accumulate(np.where(start, np.arange(len(s)), 0))]
            if last is not None:
                hub[: len(s) if same.all() else int(np.argmin(same)) + 1] = last[3]
            several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            out = several.copy()
            if last is not None and given:
                out[0] = False
            last = (s[-1], d[-1], bool(several[-1]) or (len(s) == 1 and last is not None and last[2]), hub[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(s[out]), pa.array(d[out]), pa.array(hub[out])], ["signature", "doc_id", "hub"]
            )

    return (
        signatures.repartition(count, "signature")
        .sortWithinPartitions("signature", "doc_id")
        .mapInArrow(run, "signature bigint, doc_id bigint, hub bigint")
    )


def _turns(frame: DataFrame, column: str) -> list[DataFrame]:
    """The rows in TURNS parts; those with the same value of the column lie in one."""
    turn = F.pmod(F.xxhash64(column, F.lit("turn")), F.lit(TURNS))
    return [frame.where(turn == i) for i in range(TURNS)]


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by their exact intersection.

    The set of each a is made where its text is and sent to the sets of its partners;
    b should be the side with fewer different documents.
    """

    def token_sets(batches):
        for batch in textops.slices(batches, size=_SLICE):
            values, edges = shingle_sets(*textops.flat(batch.column("text")), width)
            found = [values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.drop_columns(["text"]).columns, pa.array(found, pa.binary())],
                [*batch.drop_columns(["text"]).schema.names, "tokens"],
            )

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                one = np.frombuffer(x.as_buffer(), np.uint64)
                other = np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    partners = pairs.groupBy(F.col("a").alias("doc_id")).agg(F.collect_list("b").alias("partners"))
    one = (
        docs.join(partners, "doc_id")
        .select("doc_id", "partners", "text")
        .mapInArrow(token_sets, "doc_id bigint, partners array<bigint>, tokens binary")
        .select(F.col("doc_id").alias("a"), F.explode("partners").alias("b"), F.col("tokens").alias("set_a"))
    )
    other = (
        docs.join(pairs.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .select("doc_id", "text")
        .mapInArrow(token_sets, "doc_id bigint, tokens binary")
        .select(F.col("doc_id").alias("b"), F.col("tokens").alias("set_b"))
    )
    # a broadcast would leave both Python steps in one stage, with two workers a core
    met = one.join(other.hint("merge"), "b").select("a", "b", "set_a", "set_b")
    found = met.mapInArrow(compare, "a bigint, b bigint")
    return tables.settled(found.distinct(), "links", _BATCH)


def _sketch(tokens: np.ndarray) -> bytes:
    """A set's tokens counted modulo two, by the last bits of their hashes: 4 to 8 bits a token."""
    cells = 1 << max(6, int(len(tokens) - 1).bit_length() + 2)
    counts = np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits(counts.astype(np.uint8) & 1, bitorder="little").tobytes()


def _aligned(sketches: list[bytes]) -> np.ndarray:
    """Sketches in rows; longer ones are folded to the shortest one's cells."""
    words = min(map(len, sketches), default=8) // 8
    rows = [np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, words), axis=0) for x in sketches]
    return np.stack(rows) if rows else np.zeros((0, words), np.uint64)


def _near(one: np.ndarray, other: np.ndarray, n, m, percent: int) -> np.ndarray:
    """Whether sets may be linked, by their sizes and sketches.

    A cell that differs holds a token of one set only, so sets differ in at least as many
    tokens as cells, and linked ones in no more than (1 - similarity) / (1 + similarity)
    of both sizes.
    """
    apart = np.bitwise_count(one ^ other).sum(axis=-1, dtype=np.int64)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (
        apart * (100 + percent) <= (100 - percent) * (n + m)
    )


def _plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches don't rule out."""

    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("x", "y", "n", "m"))
            keep = [bool(_near(*_aligned([x, y]), n, m, percent)) for x, y, n, m in zip(*columns)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sketches.select(F.col("doc_id").alias("a"), "n", F.col("sketch").alias("x"))
    other = sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(
        run, "a bigint, b bigint"
    )


def _told_apart(members: DataFrame) -> DataFrame:
    """Of the groups with the very same members one stays: it holds the same pairs.

    Near copies share most of their signatures, so most groups repeat others.
    """
    mark = lambda salt: F.bit_xor(F.xxhash64("a", F.lit(salt)))
    marks = members.groupBy("signature").agg(F.count(F.lit(1)).alias("all"), mark("x").alias("x"), mark("y").alias("y"))
    first = marks.groupBy("all", "x", "y").agg(F.min("signature").alias("signature"))
    return members.join(first.select("signature"), "signature", "left_semi")


def _sizes(members: DataFrame) -> DataFrame:
    """Per open signature: all members, the largest component, members outside of it."""
    parts = members.groupBy("signature", "component").agg(F.count(F.lit(1)).alias("own"))
    whole = parts.groupBy("signature").agg(
        F.sum("own").alias("all"), F.max(F.struct("own", "component")).alias("top")
    )
    return whole.select(
        "signature", "all", F.col("top.component").alias("major"), (F.col("all") - F.col("top.own")).alias("few")
    ).where("few > 0")


def _crowds(members: DataFrame, docs: DataFrame, width: int, percent: int, rows: int) -> DataFrame:
    """Members with their group's sizes; crowded groups are split by a second signature.

    Linked sets also share a signature where their hashes are mixed anew, so in a split
    group strangers that share one signature by chance don't meet.
    """

    def run(batches):
        bands = Bands(percent)
        for batch in textops.slices(batches, size=_SLICE):
            values, edges = shingle_sets(*textops.flat(batch.column("text")), width)
            found = [
                _signatures(np.sort(textops.mix(values[a:b] ^ _SECOND)), bands).view(np.int64) if b > a else []
                for a, b in zip(edges[:-1], edges[1:])
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["a", "second"]
            )

    sizes = tables.settled(_sizes(members), "groups")
    crowded = F.col("few") > _CROWD * rows
    if sizes.where(crowded).isEmpty():
        return members.join(sizes, "signature")
    crowd = members.join(sizes.where(crowded).select("signature"), "signature")
    texts = docs.join(crowd.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text")
    second = texts.mapInArrow(run, "a bigint, second array<bigint>").select("a", F.explode("second").alias("second"))
    split = tables.settled(
        crowd.join(second, "a")
        .select(F.xxhash64("signature", "second").alias("signature"), "a", "n", "component")
        .distinct(),
        "split",
    )
    return members.join(sizes.where(~crowded), "signature").unionByName(split.join(_sizes(split), "signature"))


def _dealt(sized: DataFrame, rows: int) -> DataFrame:
    """Members in blocks of about `rows`: a row for each comparison they take part in.

    Those outside the largest component (left) meet all (right), block by block. Other
    columns are passed on.
    """
    own = [c for c in sized.columns if c not in ("signature", "all", "major", "few")]
    blocks = lambda c: F.ceil(F.col(c) / rows).cast("bigint")
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    i = F.pmod(F.xxhash64("a", F.lit("left")), blocks("few"))
    j = F.pmod(F.xxhash64("a", F.lit("right")), blocks("all"))
    cell = lambda x, y: F.struct(x.alias("i"), y.alias("j"))
    minor = F.col("component") != F.col("major")
    met = F.transform(every(blocks("few")), lambda x: cell(x, F.col("own_j")))
    asks = F.transform(every(blocks("all")), lambda y: cell(F.col("own_i"), y))
    return (
        sized.withColumn("own_i", i)
        .withColumn("own_j", j)
        .withColumn("at", F.explode(F.when(minor, F.array_union(met, asks)).otherwise(met)))
        .select(
            F.xxhash64("signature", "at.i", "at.j").alias("signature"),
            *own,
            (minor & (F.col("at.i") == F.col("own_i"))).alias("left"),
            (F.col("at.j") == F.col("own_j")).alias("right"),
        )
    )


def _meetings(dealt: DataFrame, percent: int) -> DataFrame:
    """Pairs of a block's left and right members in different components that may be linked.

    They meet by matrix operations in the task that streams the blocks; only pairs that
    pass the sketches come out.
    """
    count = tables.parallelism(dealt)

    def group(rows: pa.Table):
        part, ids = rows["component"].to_numpy(), rows["a"].to_numpy()
        n = rows["n"].to_numpy()
        few = np.flatnonzero(rows["left"].to_numpy())
        all_ = np.flatnonzero(rows["right"].to_numpy())
        if not len(few) or not len(all_):
            return
        sketch = _aligned(rows["sketch"].to_pylist())
        wide = max(1, _CELLS // sketch.shape[1])
        step = max(1, wide // len(all_))
        for at in range(0, len(few), step):
            i = few[at : at + step]
            for from_ in range(0, len(all_), wide):
                j = all_[from_ : from_ + wide]
                ok = _near(sketch[i][:, None, :], sketch[None, j, :], n[i][:, None], n[None, j], percent)
                ok &= part[i][:, None] != part[None, j]
                x, y = np.nonzero(ok)
                if len(x):
                    a, b = ids[i[x]], ids[j[y]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"]
                    )

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            s = batch.column("signature").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]]).tolist()
            for a, b in zip(edges[:-1], edges[1:]):
                if b == a:
                    continue
                if held and held[-1].column("signature")[0].as_py() != s[a]:
                    yield from group(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from group(pa.Table.from_batches(held))

    return (
        dealt.repartition(count, "signature").sortWithinPartitions("signature").mapInArrow(run, "a bigint, b bigint")
    )


def link(
    docs: DataFrame,
    width: int = WORDS,
    percent: int = PERCENT,
    id_column: str = "doc_id",
    text_column: str = "text",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Per document: doc_id, n_shingles, class_id, component_id.

    Two documents link when 100 * intersection >= percent * union of their distinct
    shingles of `width` words (between ASCII white space, A to Z lower-cased).
    class_id is the least key with the same set, component_id the least key reachable
    by links. Texts without words, and missing ones, are linked with nothing. Rows
    with the same key are one node of the graph; null keys are one node, shown as null
    (it precedes all others). Other columns are not looked at.

    Signatures of segments (`Bands`, `_signatures`) are shuffled once, so that every
    linked pair shares one. Each document is first compared with the least document of
    each of its signatures, which joins most copies; then members of a signature's
    group that still lie in different components with each other, in blocks of about
    `group_rows`, so that no task holds a whole group; where very many lie outside the
    largest component, only those that share a second signature. Sizes and small
    sketches of the sets rule most pairs out before any set is fetched, without losing
    a link, and no pair that they rule out leaves a task. Only documents of the pairs left have their sets
    computed again. Equality is that of 64-bit hashes of the shingles. What is shuffled with
    signatures or sketches goes in TURNS parts, one after the other.
    """
    key = F.coalesce(F.col(id_column), F.lit(_NO_ID))
    plain = docs.select(key.alias("doc_id"), F.col(text_column).alias("text"))
    marked = tables.settled(_fingerprinted(plain, width, percent), "signatures", _BATCH)
    sets = tables.settled(marked.select("doc_id", "n", "one", "two", "sketch"), "sets")
    heads = sets.where("n > 0").groupBy("one", "two", "n").agg(F.min("doc_id").alias("class_id"))
    classes = tables.settled(
        sets.select("doc_id", "n", "one", "two").join(heads, ["one", "two", "n"], "left").select(
            "doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id")
        ),
        "classes",
    )
    exploded = marked.select("doc_id", F.explode("signatures").alias("signature"))
    to_class = classes.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n").alias("n"))
    shared = tables.settled_in_turns(
        [
            _shared(part)
            .join(to_class, "doc_id")
            .select("signature", F.col("class_id").alias("a"), "n", "hub")
            .distinct()
            for part in _turns(exploded, "signature")
        ],
        "shared",
    )
    tables.dropped(marked)
    heads_of = to_class.select(F.col("doc_id").alias("hub"), F.col("class_id").alias("b"))
    sketches = sets.select("doc_id", "n", "sketch").dropDuplicates(["doc_id"])
    spokes = shared.select("a", "hub").distinct().join(heads_of, "hub").where("a <> b").select("a", "b").distinct()
    spokes = tables.settled(spokes, "spokes")
    near = tables.settled_in_turns(
        [_plausible(part, sketches, percent) for part in _turns(spokes, "b")], "stars", _BATCH
    )
    tables.dropped(spokes)

    # a document's least partner first: it mostly joins them, and the others need no check
    links = _verified(near.groupBy("a").agg(F.min("b").alias("b")), plain, width, percent)
    nodes = components(links)
    place = nodes.select(F.col("node").alias("a"), F.col("component").alias("x"))
    other = nodes.select(F.col("node").alias("b"), F.col("component").alias("y"))
    apart = near.join(place, "a", "left").join(other, "b", "left").where(
        "coalesce(x, a) <> coalesce(y, b)"
    ).select("a", "b")
    links = links.unionByName(_verified(apart, plain, width, percent)).distinct()
    nodes = components(links)
    placed = shared.select("signature", "a", "n").join(
        nodes.select(F.col("node").alias("a"), "component"), "a", "left"
    ).withColumn("component", F.coalesce("component", "a"))
    open_ = (
        placed.groupBy("signature")
        .agg(F.min("component").alias("x"), F.max("component").alias("y"))
        .where("x < y")
        .select("signature")
    )
    every = tables.settled(
        placed.join(open_, "signature").select("signature", "a", "n", "component").distinct(), "open"
    )
    tables.dropped(shared)
    members = tables.settled(_told_apart(every), "members")
    tables.dropped(every)
    dealt = tables.settled(_dealt(_crowds(members, plain, width, percent, group_rows), group_rows), "dealt")
    tables.dropped(members)
    sketch_of = sketches.select(F.col("doc_id").alias("a"), "sketch")
    # a pair comes out once per signature it shares: it is told apart before it is joined
    met = tables.settled_in_turns(
        [_meetings(part.join(sketch_of, "a"), percent).distinct() for part in _turns(dealt, "signature")],
        "met",
        _BATCH,
    )
    tables.dropped(dealt, sets)
    rest = tables.settled(met.distinct().join(near, ["a", "b"], "left_anti"), "rest")
    tables.dropped(near, met)
    nodes = components(links.unionByName(_verified(rest, plain, width, percent)))
    tables.dropped(rest)
    result = classes.join(nodes.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    shown = lambda c: F.when(c != _NO_ID, c)
    return result.select(
        shown(F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        shown(F.col("class_id")).alias("class_id"),
        shown(F.coalesce("component", "class_id")).alias("component_id"),
    )
